"""An instance's settings: validated dataclasses, read from YAML, written back, listed in a registry."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

from sondera.sources import files as fs


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass
class Knowledge:
    id: str = ""
    name: str = ""
    description: str = ""

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", self.id):
            raise ConfigError("knowledge.id must be letters, digits, '.', '_' or '-', and begin with a letter or digit")


@dataclass
class Quantization:
    mode: str = "none"
    oversampling: float = 2.0

    def __post_init__(self) -> None:
        if self.mode not in ("none", "scalar", "binary"):
            raise ConfigError("storage.quantization.mode must be none, scalar or binary")


@dataclass
class Storage:
    path: str = ""
    quantization: Quantization = field(default_factory=Quantization)


@dataclass
class Model:
    provider: str = "hash"
    model: str = ""
    dimensions: int = 1024
    batch_size: int = 8
    max_seq_length: int = 1024
    base_url: str = ""
    api_key_env: str = ""
    query_instruction: str = ""
    enabled: bool = False


@dataclass
class Models:
    embedding: Model = field(default_factory=Model)
    reranker: Model = field(default_factory=Model)


@dataclass
class Retrieval:
    dense_candidates: int = 40
    sparse_candidates: int = 40
    fused_candidates: int = 30
    final_results: int = 8
    fusion: str = "rrf"
    max_results_per_source: int | None = 3
    rerank: bool = False

    def __post_init__(self) -> None:
        if self.fusion != "rrf":
            raise ConfigError("retrieval.fusion must be rrf")


@dataclass
class Indexing:
    incremental: bool = True
    debounce_seconds: float = 10.0
    embed_on_watch: bool = False
    ignored_directories: list[str] = field(default_factory=lambda: sorted(fs.IGNORED_DIRS))
    ignored_extensions: list[str] = field(default_factory=lambda: sorted(fs.IGNORED_TYPES))
    follow_symlinks: bool = False


@dataclass
class Parsing:
    max_chunk_tokens: int | None = 1200
    chunk_overlap_tokens: int = 100
    ocr: bool = False
    table_structure: bool = False
    force_backend_text: bool = True


@dataclass
class Source:
    path: str = ""
    repo_url: str = ""
    ref: str = ""
    subpath: str = ""
    name: str = ""
    type: str = ""
    tags: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.path and not self.repo_url:
            raise ConfigError("a source needs a path or a repo_url")


@dataclass
class Sources:
    code: list[Source] = field(default_factory=list)
    documents: list[Source] = field(default_factory=list)


@dataclass
class Config:
    knowledge: Knowledge
    storage: Storage = field(default_factory=Storage)
    models: Models = field(default_factory=Models)
    retrieval: Retrieval = field(default_factory=Retrieval)
    indexing: Indexing = field(default_factory=Indexing)
    parsing: Parsing = field(default_factory=Parsing)
    sources: Sources = field(default_factory=Sources)

    def __post_init__(self) -> None:
        if not self.storage.path:
            self.storage.path = str(registry_dir() / "data" / self.knowledge.id)

    @property
    def collection(self) -> str:
        """The name of the instance's vectors."""
        return "kb_" + self.knowledge.id.replace("-", "_")

    def all_sources(self) -> list[Source]:
        """Code first, then documents."""
        return [*self.sources.code, *self.sources.documents]


def expand(value: Any) -> Any:
    """Strings with environment variables and the home folder filled in, at any depth."""
    if isinstance(value, str):
        return os.path.expanduser(os.path.expandvars(value))
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def _build(cls: type, data: Any, where: str = "") -> Any:
    if not isinstance(data, dict):
        raise ConfigError(f"{where or 'the file'} must be a mapping")
    hints, known = get_type_hints(cls), {f.name for f in dataclasses.fields(cls)}
    unknown = set(data) - known
    if unknown:
        raise ConfigError(f"unknown setting {where}{'.' if where else ''}{sorted(unknown)[0]}")
    out = {}
    for name, value in data.items():
        kind, path = hints[name], f"{where}.{name}".strip(".")
        if dataclasses.is_dataclass(kind):
            out[name] = _build(kind, value or {}, path)
        elif get_origin(kind) is list and dataclasses.is_dataclass(get_args(kind)[0]):
            out[name] = [_build(get_args(kind)[0], v, f"{path}[{i}]") for i, v in enumerate(value or [])]
        else:
            out[name] = value
    return cls(**out)


def load(path: str | Path) -> Config:
    """The settings of a file; relative paths are below its folder."""
    import yaml

    path = Path(path)
    config = _build(Config, expand(yaml.safe_load(path.read_text(encoding="utf-8")) or {}))
    base = path.resolve().parent
    config.storage.path = str(base / config.storage.path) if not Path(config.storage.path).is_absolute() else config.storage.path
    for source in config.all_sources():
        if source.path and not Path(source.path).is_absolute():
            source.path = str(base / source.path)
    return config


def dump(config: Config) -> str:
    """The settings as YAML."""
    import yaml

    return yaml.safe_dump(dataclasses.asdict(config), sort_keys=False, allow_unicode=True)


def registry_dir() -> Path:
    """Where instances are listed: SONDERA_HOME, else a folder in the home."""
    return Path(os.environ.get("SONDERA_HOME") or Path.home() / ".sondera")


def create(knowledge_id: str, sources: list[str], name: str = "", folder: Path | None = None) -> Path:
    """Write a new instance's settings to the registry; an existing one is an error."""
    path = (folder or registry_dir()) / f"{knowledge_id}.yaml"
    if path.exists():
        raise ConfigError(f"{knowledge_id} exists already")
    config = Config(Knowledge(knowledge_id, name or knowledge_id), sources=Sources(code=[Source(path=str(Path(s).resolve())) for s in sources]))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(dump(config), encoding="utf-8")
    return path


def create_for_docs(docs: str | Path, knowledge_id: str = "sondera-docs", folder: Path | None = None) -> Path:
    """Settings of an instance over a folder of documentation, to try the engine out on: documents only."""
    path = create(knowledge_id, [str(docs)], "Documentation", folder)
    config = load(path)
    config.sources = Sources(documents=[Source(path=s.path, type="documents") for s in config.sources.code])
    path.write_text(dump(config), encoding="utf-8")
    return path


def save(config: Config, path: str | Path) -> None:
    """Write settings over those of a file."""
    Path(path).write_text(dump(config), encoding="utf-8")


def listed(folder: Path | None = None) -> list[tuple[Path, Config]]:
    """The registry's instances by name; files that can't be read are passed over."""
    out = []
    for path in sorted((folder or registry_dir()).glob("*.y*ml")):
        try:
            out.append((path, load(path)))
        except (ConfigError, OSError, ValueError, TypeError):
            continue
    return out


def resolve(name: str) -> Path:
    """A settings file: a path, a file in this folder, or a name in the registry."""
    for path in (Path(name), Path(f"{name}.yaml"), registry_dir() / f"{name}.yaml"):
        if path.is_file():
            return path
    raise ConfigError(f"no settings for {name}")
