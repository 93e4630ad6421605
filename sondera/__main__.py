"""Command line: python -m sondera create|init-docs|list|validate|noise|index|watch|stop|reembed|search|evaluate|status|delete-index."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from sondera import config as cf


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("sondera")
    commands = parser.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create", help="write a new instance's settings")
    create.add_argument("name")
    create.add_argument("sources", nargs="+")
    docs = commands.add_parser("init-docs", help="write settings of an instance over a folder of documentation")
    docs.add_argument("folder")
    docs.add_argument("--name", default="sondera-docs")
    commands.add_parser("list", help="list the instances")
    for name, text in (
        ("validate", "check the settings"), ("noise", "files that would be noise in the index"), ("stop", "end a running watch"), ("index", "index what changed"), ("watch", "index again and again"), ("reembed", "embed all anew"),
        ("search", "search"), ("evaluate", "recall and reciprocal rank over a file of queries"), ("status", "count what is stored"), ("delete-index", "delete what is stored"),
    ):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("name")
        if name == "index":
            sub.add_argument("--force", action="store_true")
            sub.add_argument("--embed", action="store_true")
        if name == "noise":
            sub.add_argument("--ignore", action="append", default=[], metavar="CATEGORY", help="ignore the files of a category from now on")
        if name == "search":
            sub.add_argument("query")
            sub.add_argument("--limit", type=int, default=8)
            sub.add_argument("--corpus", choices=("all", "code", "documents"), default="all")
            sub.add_argument("--filter", action="append", default=[], metavar="KEY=VALUE")
        if name == "evaluate":
            sub.add_argument("dataset")
    return parser


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "create":
        print(cf.create(a.name, a.sources))
        return 0
    if a.command == "init-docs":
        print(cf.create_for_docs(a.folder, a.name))
        return 0
    if a.command == "list":
        for path, config in cf.listed():
            print(f"{config.knowledge.id}\t{path}")
        return 0
    config = cf.load(cf.resolve(a.name))
    if a.command == "validate":
        missing = [s.path for s in config.all_sources() if s.path and not Path(s.path).exists()]
        print("missing: " + ", ".join(missing) if missing else "ok")
        return int(bool(missing))

    stop = Path(config.storage.path) / "watch.stop"
    if a.command == "stop":
        stop.parent.mkdir(parents=True, exist_ok=True)
        stop.touch()
        return 0

    from pyspark.sql import functions as F

    from sondera import engine as en
    from sondera.functions import text as tx
    from sondera.session import build_session
    from sondera.sources.tables import read_evaluation
    from sondera.streaming.watch import watch

    spark = build_session()
    if a.command == "index":
        print(json.dumps(vars(en.index_config(spark, config, a.force, a.embed, lambda e, p: print(e, p, file=sys.stderr)))))
    elif a.command == "watch":
        stop.unlink(missing_ok=True)
        query = watch(spark, lambda: en.index_config(spark, config, embed=config.indexing.embed_on_watch), f"{config.storage.path}/watch", f"{config.indexing.debounce_seconds:g} seconds")
        try:
            while query.isActive and not stop.exists():
                time.sleep(1)
        except KeyboardInterrupt:
            pass
        query.stop()
        stop.unlink(missing_ok=True)
    elif a.command == "noise":
        if a.ignore:
            print(en.ignore_noise(config, a.ignore, cf.resolve(a.name)))
        en.noise(spark, config).show(truncate=False)
    elif a.command == "reembed":
        print(en.embed_config(spark, config, recreate=True))
    elif a.command == "delete-index":
        print(en.delete_index(spark, config))
    else:
        engine = en.open_engine(spark, config)
        if a.command == "status":
            engine.info().show(truncate=False)
        elif a.command == "evaluate":
            print(json.dumps(engine.evaluate(read_evaluation(spark, a.dataset)).first().asDict()))
        else:
            filters = dict(f.split("=", 1) for f in a.filter) or None
            queries = engine.queries(a.query)
            found = engine.search(queries, a.limit, filters) if a.corpus == "all" else engine.search_words(queries, a.limit, filters, a.corpus)
            for r in found.select("rank", F.round("score", 4).alias("score"), "citation", tx.preview("text").alias("preview")).orderBy("rank").collect():
                print(f"{r['rank']}. [{r['score']}] {r['citation']}\n   {r['preview']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
