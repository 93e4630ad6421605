"""Credentials embedded in code and configuration, found and redacted.

Configuration is parsed by format - JSON, YAML (with its nesting, flows and
blocks), TOML, INI, properties, environment files, XML - into key paths, each
with its value and the bytes where it stands; source code and remarks by their
assignments, arguments, look-ups with a default and flags. A value is a
credential if the last key of its path names a secret and the value is no
placeholder, reference, path or number, or if an outer key does, the last one
doesn't say otherwise, and the value looks random. Values with a shape of
their own (issued tokens, connection URLs with a password, private keys) need
no key. Redaction splices marks of the same width into the original bytes, so
quotes, line ends and everything else stay as they were.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.columns import TIE, map_rows, suffix, versions
from sondera.operators.latest import latest

#: Fewest characters of a credential that only its key shows.
LEAST = 5

#: Last words of a key that name a secret; a value that none of the
#: other tests refuses is then a credential.
SECRET_WORDS = frozenset(
    "password passwd pwd pw passphrase passcode secret token apikey apitoken credential credentials authorization bearer pass".split()
)
#: Those of them whose value, in quotes, may be several words.
PHRASE_WORDS = frozenset("password passwd pwd pw passphrase passcode".split())
#: What a text shown to users has and a passphrase doesn't.
_SENTENCE = re.compile(
    r"(?i)\b(?:pass(?:word|phrase|code|wd)s?|your|you|please|enter|type|must|should|invalid|required|incorrect|wrong|forgot(?:ten)?|confirm|log ?in|user(?:name)?)\b|[\n{}<>]|%[(\w]|\$[{(]|[.?:…]\s*$"
)
#: Words before "key" that make it a secret's name.
KEY_OWNERS = frozenset("api secret private access signing encryption service auth master account deploy storage session hmac client app admin".split())
#: What an outer key is called whose values are secrets, and last words of keys that are none there.
GROUP_WORDS = SECRET_WORDS | frozenset("secrets passwords passwds passphrases tokens apikeys auths auth login logins keys".split())
NEUTRAL_WORDS = frozenset(
    "name names type kind id ids user users username login email mail host hostname port url uri endpoint address path file filename folder dir directory mount ttl expires expiry expiration age lifetime "
    "issued created updated rotated rotation date time days hours minutes seconds ref reference source provider backend store engine vault length size count number min max limit enabled disabled required algorithm alg "
    "cipher hash digest checksum fingerprint issuer audience scope scopes region zone description comment note label title version format method mode header prefix suffix encoding charset role roles group groups owner "
    "namespace dbname schema public cert certificate".split()
)
#: What stands in a place of a secret, in lower case.
PLACEHOLDERS = frozenset(
    "todo tbd fixme changeme change_me change-me replaceme replace_me replace-me example sample dummy placeholder redacted hidden none null nil "
    "true false undefined empty secret password passwd token apikey api_key string str text value test unset default yes no".split()
)
_HOLDER_PART = re.compile(r"(?i)your[-_ ]|[-_]here$|changeme|replace[-_]?me|placeholder|redacted|example|insert[-_]|<[^>]*>|\.\.\.|^(.)\1{3,}$|^x{3,}|x{6,}|\*{3,}|^(?:sk|pk)_test_?x*$")
_REFERENCE = re.compile(
    r"(?i)^(?:\$\{|\$\(|\$[A-Za-z_]|\{\{|\{%|%\(|%[A-Z_]+%|<|@|#\{|(?:vault|env|ssm|file|secretref|secretsmanager|sops|op|keyring|ref|arn|projects|k8s|secret|config|keychain|gcp|aws|azure):|env\.|process\.env|os\.|!vault|!ref|!sub)"
)
_PATH = re.compile(r"^(?:~|\.{0,2})/[\w.\-/]*$|^[A-Za-z]:\\|^[\w.\-]+(?:/[\w.\-]+)+\.\w{1,5}$")
_NUMBER = re.compile(r"^[-+]?[\d_.,]+(?:[a-zA-Z%]{1,2})?$")

#: Shapes of issued tokens, which need no key.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{18,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|xox[abeprs]-[\w\-]{16,}"
    r"|[spr]k_live_[A-Za-z0-9]{16,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}|AIza[\w\-]{30,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{30,}"
    r"|[a-z]{2,6}_(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{24,}|[a-z]{2,8}-(?:prod|live|stage|staging|dev|test)-(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{16,})(?![A-Za-z0-9_\-/+=])"
)
_SCHEME = re.compile(r"(?i)(?<![\w])(?:bearer|basic|token)\s+([A-Za-z0-9._~+/=\-]{16,})")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@'\"`<>]*:([^\s@/'\"`<>]+)@[\w.\-\[]")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: What may stand between two lines of a key: line ends (written out, too), quotes, signs of joining and of remarks.
_KEY_BREAK = re.compile(r"(?:\\[rn]|[\s\"'`+,;|>#*.()\\]|//)*")
_KEY_PART = re.compile(r"[A-Za-z0-9+/=]+")
#: A line of a key's body, with what may stand around it where it is a literal or a remark.
_KEY_LINE = re.compile(r"[\s\"'`+,;|>#*.()\\]*(?://)?\s*([A-Za-z0-9+/=]+)(?:\\[rn])*[\s\"'`+,;)\\]*$")

#: A text without one of these, in lower case, holds no credential.
_WORDS_OF_SECRETS = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "authori", "bearer ", "basic ", "private key")
_SOME_KEY = re.compile(r"(?:" + "|".join(sorted(KEY_OWNERS)) + r")[_\-. ]?keys?(?![a-z])")
_SHORT_NAMES = re.compile(r"(?:\b|[a-z]|_)pass(?![a-z])|(?:\b|_|[a-z])pw(?![a-z])")
_URL_HINT = re.compile(r"://[^\s/@]*:[^\s@]+@")
_ISSUED_HINT = re.compile(r"gh[pousr]_|github_pat_|AKIA|ASIA|xox[abeprs]-|k_live_|eyJ|AIza|hf_|npm_|glpat-|_[A-Za-z0-9]{16}|-(?:prod|live|stage|staging|dev|test)-[A-Za-z0-9]{8}")
#: A line without one of these can't hold a credential.
_HINT = re.compile(
    r"passw|passphrase|passcode|pass\b|pass[\"'_]|pwd|pw\b|pw[\"']|secret|token|apikey|api[_\-]?key|credential|authori[sz]ation|bearer|basic |_key|-key|[a-z]key\b|PRIVATE KEY|://[^\s/:@]*:[^\s/@]+@"
    r"|gh[pousr]_|AKIA|ASIA|xox[abeprs]-|k_live_|eyJ|AIza|hf_|npm_|glpat|-(?:prod|live|stage|staging|dev|test)-|\b[a-z]{2,6}_[a-z0-9]{16}",
    re.I,
)

_QUOTED = re.compile(r"(?P<q>[rbuf]{0,2}(?:\"\"\"|'''|\"|'|`))")
_KEY = r"(?P<key>[A-Za-z_][A-Za-z0-9_.\-]*)"
#: key, then what may close a subscript or a quoted key, a type, and a sign of assignment or comparison
_ASSIGN = re.compile(
    # from the beginning of a word and without going back in it, so a very long one is read once
    r"(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<key>[A-Za-z_][A-Za-z0-9_.\-]*+)" + r"(?:[\"'`]\s*)?\]?\)?\s*(?::\s*(?:str|string|String|bytes|Optional\[str\]|\*?string)\s*)?(?P<op>:=|===?|!==?|=>|=|:|\bwas\b|\bis\b|,(?=\s*[\"'`]))[ \t]*\(?[ \t]*"
)
_DEFINE = re.compile(r"#\s*define\s+" + _KEY + r"[ \t]+")
_FLAG = re.compile(r"(?<![\w\-])--(?P<key>[A-Za-z][A-Za-z0-9\-]*)(?:=|[ \t]+)")
_TAG = re.compile(r"<(?P<key>[A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[)?(?P<value>[^<>\n]+?)(?:\]\]>)?\s*</")
_ATTRS = re.compile(r"(?:key|name|id|property|field)\s*[=:]\s*[\"']?(?P<key>[A-Za-z_][\w.\-]*)[\"']?[\s,;]+(?:value|content|default|val)\s*[=:]\s*")
_VALUE_ONLY = re.compile(r"^\s*[\"']?(?:value|default|content|data|val)[\"']?\s*[:=]\s*")
_NAME_ONLY = re.compile(r"^\s*(?:-\s*)?[\"']?(?:name|key)[\"']?\s*[:=]\s*[\"']?(?P<key>[A-Za-z_][\w.\-]*)[\"']?\s*,?\s*$")
_REMARK = re.compile(r"^\s*(?:#|//|/\*|\*|;|--|<!--|%)")
_NEXT_PART = re.compile(r"\s*(?:\+|\.\.|\\)?\s*\\?(?:\n\s*)?[rbuf]{0,2}([\"'`])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Two literals of which the second is joined on to the first.
_SEAM = re.compile(r"[\"'`][ \t]*(?:\+|\.\.|\\)[ \t]*\\?\n?[ \t]*[rbuf]{0,2}[\"'`]")

#: File types of each format of configuration, and those whose values stand without quotes.
FORMATS = {
    "json": frozenset("json jsonc json5 jsonl ndjson ipynb webmanifest tfstate".split()), "yaml": frozenset("yaml yml".split()), "xml": frozenset("xml config csproj plist xsd wsdl pom".split()),
    "sections": frozenset("toml ini cfg conf cnf properties env editorconfig service desktop lock".split()),
}
CONFIG_TYPES = frozenset("yaml yml ini env toml cfg conf cnf properties sh bash txt md xml".split())
#: Keys of a pair of a name and its value.
NAME_KEYS, VALUE_KEYS = frozenset("name key id property field".split()), frozenset("value default content data val".split())


class Entry(NamedTuple):
    """A value of a configuration: the keys that lead to it from the outermost, where it stands, and whether it is in quotes."""

    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool


class Found(NamedTuple):
    """A credential or a piece of one: its line from 1, the bytes it takes up, its key path, and whether it begins there."""

    line_no: int
    start: int
    end: int
    key: str = ""
    begins: bool = True


def _name_words(key: str) -> list[str]:
    words = [w.lower() for w in _WORDS.findall(key.rsplit(".", 1)[-1])]
    while len(words) > 1 and words[-1].isdigit():
        words.pop()
    return words


def is_secret_name(key: str) -> bool:
    """Whether a key's last word names a secret: api_key and dbPassword do, token_count doesn't."""
    words = _name_words(key)
    if not words:
        return False
    if words[-1] == "key":
        return len(words) > 1 and words[-2] in KEY_OWNERS
    return words[-1] in SECRET_WORDS and not (len(words) > 1 and words[-2] in ("max", "min", "num", "n", "total"))


def is_secret_group(key: str) -> bool:
    """Whether what stands below a key are secrets: secrets, credentials, api_keys."""
    words = _name_words(key)
    return bool(words) and (is_secret_name(key) or (words[-1] in GROUP_WORDS and (words[-1] != "keys" or (len(words) > 1 and words[-2] in KEY_OWNERS))))


def _may_be_words(key: str) -> bool:
    """Whether a key's last word names a secret that can be of several words."""
    words = [w for w in _name_words(key) if not w.isdigit()]
    return bool(words) and words[-1] in PHRASE_WORDS


def is_secret_value(value: str, words: bool = False, least: int = LEAST) -> bool:
    """Whether a value can be a secret: no placeholder, reference, path, number or, without ``words``, phrase."""
    value = value.strip()
    scheme = re.match(r"(?i)(?:bearer|basic|token)\s+(.*)$", value)
    if scheme:
        value = scheme[1]
    bare = value.strip("\"'`")
    return (
        least <= len(bare)
        and bare.lower() not in PLACEHOLDERS
        and not any(p.search(bare) for p in (_HOLDER_PART, _REFERENCE, _PATH, _NUMBER))
        and (not re.search(r"\s", bare) or (words and not _SENTENCE.search(bare)))
        and "://" not in bare
    )


def looks_random(value: str) -> bool:
    """Whether a value has eight characters or more of several kinds, and no name of a host, a file or a day."""
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z\d\s]"))
    return len(value) >= 8 and kinds >= 2 and bool(re.search(r"\d|[a-z][A-Z]|[!#$%^&*+=@]", value)) and not re.search(r"\s|^\d{4}-\d\d|^[\w\-]+(?:\.[\w\-]+)+(?::\d+)?$", value)


def is_credential(path: tuple[str, ...], value: str, quoted: bool, least: int = LEAST) -> bool:
    """Whether a value at a key path is a credential."""
    keys = [k for key in path for k in key.split(".") if k]
    if not keys:
        return False
    if keys[-1].lower() in VALUE_KEYS and len(keys) > 1:
        keys.pop()
    last = keys[-1]
    if is_secret_name(last):
        return is_secret_value(value, _may_be_words(last), least) if quoted else _plain_value(value, False, least)
    words = _name_words(last)
    if (words and words[-1] in NEUTRAL_WORDS and not is_secret_group(last)) or not any(map(is_secret_group, keys)):
        return False
    return is_secret_value(value, False, least) and looks_random(value) and (quoted or _plain_value(value, False, least))


def _plain_value(value: str, remark: bool, least: int = LEAST) -> bool:
    """An unquoted value: in remarks it must not read like a word of a sentence."""
    if not is_secret_value(value, False, least) or re.search(r"[(){}\[\]<>$]", value):
        return False
    return not remark or bool(re.search(r"\d|[-_/+=!@%^&*]", value)) or bool(re.search(r"[a-z][A-Z]", value))


def _read_quoted(text: str, at: int) -> tuple[list[tuple[int, int]], str] | None:
    """A string literal at ``at`` with what is joined on to it: where its pieces stand, and the whole value."""
    m = _QUOTED.match(text, at)
    if not m:
        return None
    parts, pieces, quote, i = [], [], m["q"].lstrip("rbufRBUF"), m.end()
    while True:
        close = i
        while True:
            close = text.find(quote, close)
            if close < 0 or (len(quote) == 1 and quote != "`" and "\n" in text[i:close]):
                return None
            if text[close - 1] != "\\" or quote == "`" or close == i:
                break
            close += 1
        parts.append(text[i:close])
        pieces.append((i, close))
        more = _NEXT_PART.match(text, close + len(quote))
        joined = more and ("+" in more[0] or "\\" in more[0] or ".." in more[0])
        if not joined:
            return pieces, "".join(parts)
        i, quote = more.end(), more[1]


# --- formats of configuration

_FLOW = re.compile(
    r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[{}\[\],]|[:=]|(?://|\#)[^\n]*|/\*.*?\*/|[^\s{}\[\],"\':=#/](?:[^{}\[\],\n:=]|[:=](?![\s"\'{\[]))*|[^\s]', re.S
)
_COLON = re.compile(r"\s*[:=]")


class _Frame:
    """An object, element or list that is open: its key, the name of its pair, the values of its pair."""

    __slots__ = ("key", "name", "values")

    def __init__(self, key: str | None):
        self.key, self.name, self.values = key, None, []

    def add(self, key: str, entry: Entry, value: str) -> None:
        if key.lower() in NAME_KEYS:
            self.name = value
        elif key.lower() in VALUE_KEYS:
            self.values.append(entry)

    def pairs(self) -> list[Entry]:
        """Values under the name beside them."""
        return [e._replace(path=(*e.path[:-1], self.name)) for e in self.values] if self.name else []


def flow_entries(text: str, at: int = 0, stop: int | None = None, path: tuple[str, ...] = ()) -> list[Entry]:
    """The values of JSON, or of a flow of YAML or TOML; what is cut off before or after does no harm."""
    out: list[Entry] = []
    stack: list[_Frame] = []
    inside, key = list(path), None
    for m in _FLOW.finditer(text, at, len(text) if stop is None else stop):
        token = m[0]
        first = token[0]
        if token in "{[":
            stack.append(_Frame(key))
            inside.append(key or "")
            key = None
        elif token in "}]":
            if stack:
                out += stack.pop().pairs()
                inside.pop()
            key = None
        elif token == ",":
            key = None
        elif token in ":=" or token.startswith(("//", "/*", "#")):
            continue
        else:
            quoted = first in "\"'" and len(token) > 1
            start, end = (m.start() + 1, m.end() - 1) if quoted else (m.start(), m.start() + len(token.rstrip()))
            if key is None and _COLON.match(text, m.end()) and (quoted or not re.search(r"\s", text[start:end])):
                key = text[start:end]
                continue
            entry = Entry((*[k for k in inside if k], *([key] if key else [])), start, end, quoted)
            out.append(entry)
            if stack and key:
                stack[-1].add(key, entry, text[start:end])
            key = None
    for frame in reversed(stack):
        out += frame.pairs()
    return out


_YAML_LINE = re.compile(r"(?P<in>[ \t]*(?:-[ \t]+)*)(?:(?P<q>\"|')(?P<quoted>[^\n]*?)(?P=q)|(?P<plain>[^\s#\-\[\]{},&*!|>'\"%@`:][^\n#]*?|-?[\w.\-/]+))\s*:(?:[ \t]+|$)")
_YAML_VALUE = re.compile(r"[ \t]*(?:[!&][^\s]*[ \t]+)*")


def yaml_entries(text: str) -> list[Entry]:
    """The values of YAML by indentation, with flows, blocks and pairs of names and values."""
    out: list[Entry] = []
    # (indent, key, frame of the mapping that the key is in)
    stack: list[tuple[int, str]] = []
    frames: dict[int, _Frame] = {}
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, begin, at = text[at:end].rstrip("\r"), at, end + 1
        bare = line.lstrip()
        if not bare or bare.startswith(("#", "---", "...")):
            continue
        m = _YAML_LINE.match(line)
        if not m:
            item = re.match(r"[ \t]*(?:-[ \t]+)*", line)
            indent = len(item[0])
            while stack and stack[-1][0] >= indent:
                stack.pop()
            out += _yaml_value(text, begin + indent, begin + len(line), tuple(k for _, k in stack))[0]
            continue
        indent = len(m["in"])
        while stack and stack[-1][0] >= indent:
            stack.pop()
        for deeper in [i for i in frames if i > indent or (i == indent and "-" in m["in"])]:
            out += frames.pop(deeper).pairs()
        key = m["quoted"] if m["q"] else m["plain"]
        path = (*[k for _, k in stack], key)
        stack.append((indent, key))
        made, at_ = _yaml_value(text, begin + m.end(), begin + len(line), path, len(line) - len(bare))
        at = max(at, at_)
        out += made
        if len(made) == 1 and made[0].path == path:
            frames.setdefault(indent, _Frame(key)).add(key, made[0], text[made[0].start : made[0].end])
    for frame in frames.values():
        out += frame.pairs()
    return out


def _yaml_value(text: str, at: int, stop: int, path: tuple[str, ...], indent: int = 0) -> tuple[list[Entry], int]:
    """What stands after a key, and the place from which to read on."""
    at = _YAML_VALUE.match(text, at, stop).end()
    if at >= stop:
        return [], stop
    first = text[at]
    if first in "\"'":
        close = at + 1
        while True:
            close = text.find(first, close)
            if close < 0:
                return [], stop
            if first == '"' and text[close - 1] == "\\":
                close += 1
            elif first == "'" and text[close + 1 : close + 2] == "'":
                close += 2
            else:
                return [Entry(path, at + 1, close, True)], max(stop, close + 1)
    if first in "{[" and text[at : at + 2] != "{{":
        depth, end = 0, at
        for m in re.finditer(r"[{}\[\]]", text[at:]):
            depth += 1 if m[0] in "{[" else -1
            if not depth:
                end = at + m.end()
                break
        else:
            end = stop
        return flow_entries(text, at, end, path), max(stop, end)
    if first in "|>" and re.fullmatch(r"[|>][-+\d]*\s*(?:#.*)?", text[at:stop]):
        # lines that are indented more than the key's
        end = line = stop
        while line < len(text):
            below = text.find("\n", line + 1)
            below = len(text) if below < 0 else below
            row = text[line + 1 : below]
            if row.strip() and len(row) - len(row.lstrip()) <= indent:
                break
            end = line = below
        start = stop + len(text[stop:end]) - len(text[stop:end].lstrip())
        value = text[start:end].rstrip()
        # a block of one line is a value; a longer one is a text of its own
        return ([Entry(path, start, start + len(value), True)] if value and "\n" not in value else []), end
    value = re.split(r"\s+#", text[at:stop], maxsplit=1)[0].rstrip()
    return ([Entry(path, at, at + len(value), False)] if value else []), stop


_SECTION = re.compile(r"\s*\[+\s*([^\]\n]+?)\s*\]+\s*(?:[#;].*)?$")
_SETTING = re.compile(r"\s*(?:export\s+|set\s+|ENV\s+)?(?P<key>[A-Za-z_\"'][\w.\-\"'/ ]*?)\s*[=:]\s*")


def section_entries(text: str) -> list[Entry]:
    """The values of TOML, INI, properties and environment files, under their section."""
    out: list[Entry] = []
    section: tuple[str, ...] = ()
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, begin, at = text[at:end].rstrip("\r"), at, end + 1
        if not line.strip() or line.lstrip()[0] in "#;!":
            continue
        head = _SECTION.match(line)
        if head:
            section = tuple(p.strip(" \"'") for p in re.split(r"[.:/ ]", head[1]) if p.strip(" \"'"))
            continue
        m = _SETTING.match(line)
        if not m:
            continue
        path = (*section, *[p.strip(" \"'") for p in m["key"].split(".")])
        place, stop = begin + m.end(), begin + len(line)
        long = text[place : place + 3]
        if long in ('"""', "'''"):
            close = text.find(long, place + 3)
            if close > 0:
                start = place + 3 + len(text[place + 3 : close]) - len(text[place + 3 : close].lstrip())
                value = text[start:close].rstrip()
                if value and "\n" not in value:
                    out.append(Entry(path, start, start + len(value), True))
                at = max(at, close + 3)
            continue
        if text[place : place + 1] in ("{", "[") and text[place : place + 2] != "{{":
            close = text.find("]" if text[place] == "[" else "}", place)
            close = stop if close < 0 else close + 1
            out += flow_entries(text, place, max(stop, close), path)
            at = max(at, close)
            continue
        literal = _read_quoted(text, place)
        if literal and literal[0][-1][1] <= stop:
            out.append(Entry(path, literal[0][0][0], literal[0][-1][1], True))
        else:
            value = re.split(r"\s+[#;]", text[place:stop], maxsplit=1)[0].rstrip()
            if value:
                out.append(Entry(path, place, place + len(value), False))
    return out


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[?!][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z_][\w:.\-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_XML_ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_entries(text: str) -> list[Entry]:
    """The values of XML: texts of elements and attributes, under their elements."""
    out: list[Entry] = []
    frames: list[_Frame] = []
    at = 0

    def text_at(start: int, end: int) -> None:
        value = text[start:end]
        bare = value.strip()
        if bare and frames:
            start += len(value) - len(value.lstrip())
            entry = Entry(tuple(f.key for f in frames), start, start + len(bare), True)
            out.append(entry)
            if len(frames) > 1:
                frames[-2].add(frames[-1].key, entry, bare)

    for m in _XML.finditer(text):
        text_at(at, m.start())
        at = m.end()
        if m["cdata"] is not None:
            text_at(m.start("cdata"), m.end("cdata"))
        if not m["tag"]:
            continue
        tag = m["tag"].rsplit(":", 1)[-1]
        if m["close"]:
            keys = [f.key for f in frames]
            if tag in keys:
                while frames:
                    frame = frames.pop()
                    out.extend(frame.pairs())
                    if frame.key == tag:
                        break
            continue
        frame = _Frame(tag)
        base = (*[f.key for f in frames], tag)
        for a in _XML_ATTR.finditer(m["attrs"]):
            group = 2 if a[2] is not None else 3
            start, end = m.start("attrs") + a.start(group), m.start("attrs") + a.end(group)
            entry = Entry((*base, a[1].rsplit(":", 1)[-1]), start, end, True)
            out.append(entry)
            frame.add(a[1].rsplit(":", 1)[-1], entry, a[group])
        # the pair of attributes of an element is whole at once, and its name may head its text
        out.extend(frame.pairs())
        if not m["empty"]:
            frames.append(_Frame(tag))
            if frame.name and not frame.values:
                frames[-1].key = frame.name if is_secret_name(frame.name) else tag
    for frame in frames:
        out.extend(frame.pairs())
    return out


def entries(text: str, kind: str) -> list[Entry]:
    """The values of a configuration of a file type with their key paths; none for other types."""
    if kind in FORMATS["json"]:
        return flow_entries(text)
    if kind in FORMATS["yaml"]:
        return yaml_entries(text)
    if kind in FORMATS["xml"]:
        return xml_entries(text)
    if kind in FORMATS["sections"]:
        return section_entries(text)
    return []


_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[ \t]*([\w+\-]*)[^\n]*\n(.*?)(?:^[ \t]*\1|\Z)", re.M | re.S)


def find(text: str, kind: str = "", least: int = LEAST) -> list[Found]:
    """The credentials of a text in order; ``kind`` is its file type (``yaml``, ``py``), ``least`` the fewest characters of a keyed one.

    Places are those of the bytes of the text in UTF-8.
    """
    if not text or not _may_hold(text):
        return []
    # one character for each byte, so that places in it are bytes
    if not text.isascii():
        text = text.encode("utf-8", "surrogatepass").decode("latin-1")
    spans: dict[tuple[int, int], tuple[str, bool]] = {}

    def add(pieces: list[tuple[int, int]], key: str) -> None:
        for i, piece in enumerate(pieces):
            if piece[1] > piece[0]:
                had = spans.get(piece)
                spans[piece] = (max(had[0], key, key=len), had[1] or not i) if had else (key, not i)

    for entry in entries(text, kind):
        if is_credential(entry.path, text[entry.start : entry.end], entry.quoted, least):
            add([(entry.start, entry.end)], ".".join(entry.path))
    if kind in ("md", "markdown", "rst"):
        for m in _FENCE.finditer(text):
            for e in entries(m[3], m[2].lower()):
                if is_credential(e.path, m[3][e.start : e.end], e.quoted, least):
                    add([(m.start(3) + e.start, m.start(3) + e.end)], ".".join(e.path))
    for pieces in _blocks(text):
        spans |= {piece: ("private key", begins) for piece, begins in pieces}
    keys = sorted(p for p, (key, _) in spans.items() if key == "private key")
    unquoted, lines_done, k = kind in CONFIG_TYPES, -1, 0
    for hint in _HINT.finditer(text):
        if hint.start() < lines_done:
            continue
        while k < len(keys) and keys[k][1] <= hint.start():
            k += 1
        if k < len(keys) and keys[k][0] < hint.start():
            continue
        begin = text.rfind("\n", 0, hint.start()) + 1
        lines_done = text.find("\n", hint.start())
        lines_done = len(text) if lines_done < 0 else lines_done
        for pieces, key in _line(text, text[begin:lines_done], begin, unquoted, least):
            add(pieces, key)
    read = 0
    for m in _SEAM.finditer(text):
        # further seams of a literal are read with its first
        if m.start() < read:
            continue
        pieces, value = _joined(text, m.start()) or ([], "")
        read = pieces[-1][1] if pieces else read
        if _has_shape(value):
            add(pieces, "")
    out, line_no, seen = [], 1, 0
    for (start, end), (key, begins) in sorted(spans.items()):
        line_no += text.count("\n", seen, start)
        seen = start
        if out and start < out[-1].end:
            last = out[-1]
            if end > last.end:
                # what hangs over is a piece of its own only if it begins on another line
                out[-1] = last._replace(end=end) if last.line_no == line_no else last
                if last.line_no != line_no:
                    out.append(Found(line_no, last.end, end, key, begins))
            continue
        out.append(Found(line_no, start, end, key, begins))
    return out


def _may_hold(text: str) -> bool:
    """Whether a text may hold a credential: a quick test that most texts fail."""
    low = text.lower()
    if any(w in low for w in _WORDS_OF_SECRETS) or ("://" in low and "@" in low and _URL_HINT.search(low)):
        return True
    return ("key" in low and bool(_SOME_KEY.search(low))) or (("pass" in low or "pw" in low) and bool(_SHORT_NAMES.search(low))) or bool(_ISSUED_HINT.search(text))


def _blocks(text: str):
    """Private keys: pieces with whether they begin there. One that is cut off goes as far as its lines do."""
    if "PRIVATE KEY" not in text:
        return
    begins, ends = list(_BEGIN.finditer(text)), list(_END.finditer(text))
    begun, ended = [m.start() for m in begins], [m.start() for m in ends]
    done = 0
    for i, m in enumerate(begins):
        if m.start() < done:
            continue
        k = bisect_left(ended, m.end())
        another = begun[i + 1] if i + 1 < len(begun) else len(text)
        ending = ends[k] if k < len(ends) and ended[k] < another else None
        last = ending.end() if ending else another
        body = _KEY_BODY.search(text[m.end() : last].replace("\\n", " \n"))
        if body:
            last = last if ending else _key_end(text, m.end() + body.start())
            yield [((m.start(), last), True)]
            done = last
    # the rest of a key that began in another chunk
    for k, m in enumerate(ends):
        if bisect_left(begun, m.start()) > (bisect_left(begun, ended[k - 1]) if k else 0):
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        top = None
        while start > 0:
            above = text.rfind("\n", 0, start - 1) + 1
            row = _KEY_LINE.match(text[above : start - 1])
            if not row or (len(row[1]) < 16 and top is not None):
                break
            top = start = above
        if top is not None and _KEY_BODY.search(text[top : m.start()]):
            yield [((top, m.end()), False)]


def _key_end(text: str, at: int) -> int:
    """Where the lines of a private key end that begin at ``at`` and have no end mark."""
    end = at
    while True:
        part = _KEY_PART.match(text, _KEY_BREAK.match(text, end).end())
        if not part:
            return end
        if len(part[0]) < 16:
            # the last line is shorter: a group of four, or what is left where the text is cut
            whole = len(part[0]) % 4 == 0 and re.search(r"[A-Z0-9+/=]", part[0]) and re.match(r"[\"'`,;)]|\s*$|\\[rn]", text[part.end() : part.end() + 2], re.M)
            return part.end() if whole or part.end() == len(text) else end
        end = part.end()


def _joined(text: str, seam: int) -> tuple[list[tuple[int, int]], str] | None:
    """The literal that is closed at a seam, with what is joined on to it."""
    begin = text.rfind("\n", 0, seam) + 1
    opened = text.rfind(text[seam], begin, seam)
    return _read_quoted(text, opened) if opened >= 0 else None


def _has_shape(value: str) -> bool:
    """Whether a whole value has the shape of an issued token, a connection URL with a password or a scheme with one."""
    issued, url, scheme = _ISSUED.fullmatch(value), _URL.match(value), re.fullmatch(r"(?i)(?:bearer|basic)\s+([A-Za-z0-9._~+/=\-]{16,})", value)
    return bool((issued and not _HOLDER_PART.search(value)) or (url and _is_url_secret(url[1])) or (scheme and is_secret_value(scheme[1]) and re.search(r"\d|[A-Z]", scheme[1])))


def _is_url_secret(word: str) -> bool:
    return not (_REFERENCE.match(word) or _HOLDER_PART.search(word) or word.lower() in PLACEHOLDERS or re.search(r"[{}$]", word))


def _line(text: str, line: str, begin: int, unquoted: bool, least: int):
    """What of a line of code, a remark or a command is a credential: its pieces and its key."""
    remark = bool(_REMARK.match(line))
    for m in _URL.finditer(line):
        if _is_url_secret(m[1]):
            yield [(begin + m.start(1), begin + m.end(1))], "url"
    for m in _ISSUED.finditer(line):
        if not _HOLDER_PART.search(m[0]):
            yield [(begin + m.start(), begin + m.end())], ""
    for m in _SCHEME.finditer(line):
        if is_secret_value(m[1]) and re.search(r"\d|[A-Z]", m[1]) and re.search(r"(?i)authori[sz]ation|bearer|basic", line) and len(set(m[1])) > 6:
            yield [(begin + m.start(1), begin + m.end(1))], ""
    for m in _TAG.finditer(line):
        if is_secret_name(m["key"]) and is_secret_value(m["value"], _may_be_words(m["key"]), least):
            yield [(begin + m.start("value"), begin + m.end("value"))], m["key"]
    for pattern in (_ATTRS, _DEFINE, _FLAG, _ASSIGN):
        at = 0
        while True:
            m = pattern.search(line, at)
            if not m:
                break
            at = m.end("key")
            if not is_secret_name(m["key"]):
                continue
            place = begin + m.end()
            op = m.groupdict().get("op") or ""
            literal = _read_quoted(text, place)
            if literal:
                words = op not in (",", "==", "!=", "===", "!==") and _may_be_words(m["key"])
                if is_secret_value(literal[1], words, least) and not (op == "," and not re.search(r"(?i)getenv|environ|get\w*\(|default|setting|config|header|set\w*\(", line)):
                    yield literal[0], m["key"]
                continue
            if op in ("==", "!=", "===", "!==", ","):
                continue
            after = text[place : begin + len(line)]
            rest = re.match(r"((?:(?i:bearer|basic|token)[ \t]+)?[^\s\"'`,;]+)[,;]?[ \t]*(?:(?:#|//).*)?\r?$", after)
            value = rest[1] if rest else ""
            if not value and not after.strip(" \t\r>|-+(\\"):
                yield from _below(text, begin + len(line), unquoted, m["key"], False, least)
            elif value and (unquoted or remark or pattern is _FLAG) and _plain_value(value, remark or op in ("was", "is"), least):
                if op == "is" and not re.search(r"\d", value):
                    continue
                yield [(place, place + len(value))], m["key"]
            elif not rest and (unquoted or remark) and op in ("=", ":", "was"):
                one = re.match(r"[^\s\"'`,;)\]}<]{8,}", after)
                if one and _plain_value(one[0].rstrip("."), True, least) and re.search(r"\d", one[0]) and not re.search(r"[(\[]", one[0]):
                    yield [(place, place + len(one[0]))], m["key"]
    name = _NAME_ONLY.match(line)
    if name and is_secret_name(name["key"]):
        yield from _below(text, begin + len(line), unquoted, name["key"], True, least)


def _below(text: str, at: int, unquoted: bool, key: str, named: bool, least: int):
    """The value on the line after a key that stands alone."""
    begin = at + 1
    stop = text.find("\n", begin)
    line = text[begin : len(text) if stop < 0 else stop]
    own = _VALUE_ONLY.match(line)
    if named and not own:
        return
    place = begin + (own.end() if own else len(line) - len(line.lstrip()))
    literal = _read_quoted(text, place)
    if literal:
        if is_secret_value(literal[1], _may_be_words(key), least):
            yield literal[0], key
    elif unquoted:
        value = text[place : begin + len(line)].strip().rstrip(",;")
        if value and ":" not in value and "=" not in value.rstrip("=") and _plain_value(value, False, least):
            yield [(place, place + len(value))], key


def redact(text: str, found: list[Found], mark: str = "*") -> bytes:
    """The text's bytes with every credential overwritten, byte for byte.

    Line ends inside a credential (a private key) stay, so lines keep their numbers.
    """
    raw = text.encode("utf-8", "surrogatepass")
    parts, at, hidden = [], 0, re.compile(rb"[^\r\n]")
    for f in sorted(found, key=lambda f: f.start):
        start = max(at, f.start)
        parts += [raw[at:start], hidden.sub(mark.encode(), raw[start : f.end])]
        at = max(at, f.end)
    return b"".join([*parts, raw[at:]])


_ROWS = "array<struct<line_no:int,start:int,end:int,key:string,begins:boolean>>"


def find_credentials(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """Credentials of every chunk: chunk_id, found (line_no, start, end, key, begins), redacted.

    ``start`` and ``end`` are bytes of the text in UTF-8, ``key`` the key path
    (empty where the shape alone told), ``begins`` is false for further pieces
    of a credential and for the rest of a private key that began in another
    chunk; ``redacted`` is the text with the credentials overwritten and
    otherwise the same, byte for byte. Values under a key that are shorter than
    ``least`` characters count as none. Of each chunk the latest version
    counts. Chunks without credentials, without a text or without an id give
    no rows; a missing path means that values need quotes. A private key's
    lines without its first and last one can't be told from other data. Other
    columns are ignored.
    """
    rows = versions(chunks, "text", "source_path").withColumn("_kind", suffix(F.col("source_path")))

    def scan(text: str | None, kind: str):
        found = find(text, kind, least) if text else []
        return ([f._asdict() for f in found], redact(text, found).decode("utf-8", "surrogatepass")) if found else (None, None)

    scanned = map_rows(
        rows, f"chunk_id string, indexed_at timestamp, {TIE} long, found {_ROWS}, redacted string", scan,
        ["chunk_id", "indexed_at", TIE], ["text", "_kind"],
    )
    return latest(scanned, "chunk_id", "indexed_at", ["found", "redacted"], TIE).where(F.col("found").isNotNull())
