"""Front matter of pages: the header is cut out by the JVM; only the header, never the page, is read line by line in Python (Arrow)."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = r"(?s)^---\n(.*?)\n---\n?"
#: Fields read as lists, in the order of the relations they give.
LISTS = ("tags", "sources", "contradicts", "supersedes", "supports", "related_to", "key_claims")
_STAMP = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d:\d\d)(?:\.\d+)?(?:Z|([+-])(\d\d):(\d\d)))?")


def parse_header(text: str) -> dict[str, str | list[str]]:
    """Key to scalar or list. A line with a colon opens a key at the first colon; `[]` or nothing after it opens a list that `- x` lines
    (with no or two blanks before) fill; a quoted empty value is an empty scalar; a value that starts with `[` stays as it stands; the last key of a name wins."""
    found: dict[str, str | list[str]] = {}
    open_list: list[str] | None = None
    for line in text.split("\n"):
        if line.startswith(("- ", "  - ")):
            if open_list is not None:
                open_list.append(line.removeprefix("  - ").removeprefix("- ").strip().strip("\"'"))
            continue
        key, colon, raw = line.rstrip(" ").partition(":")
        if not colon:
            continue
        key, raw, open_list = key.strip(), raw.strip(), None
        value = raw.strip("\"'")
        if value == "[]" or (not value and raw not in ('""', "''")):
            found[key] = open_list = []
        else:
            found[key] = raw if raw.startswith("[") else value
    return found


def as_list(value: str | list[str] | None) -> list[str] | None:
    """A list as it is; an inline list split at commas, trimmed, unquoted, without empty items; other text split at commas as it stands."""
    if value is None or value == "":
        return None
    if isinstance(value, list):
        return value
    if value.startswith("[") and value.endswith("]"):
        items = (p.strip().strip("\"'") for p in value[1:-1].split(","))
        return [p for p in items if p]
    return value.split(",")


def epoch(value: str) -> int:
    """Seconds of a date, or of a date and time with zone; 0 for anything else."""
    m = _STAMP.fullmatch(value)
    if not m:
        return 0
    try:
        at = datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}").replace(tzinfo=UTC)
        if m[3]:
            at = at.replace(tzinfo=timezone((1 if m[3] == "+" else -1) * timedelta(hours=int(m[4]), minutes=int(m[5]))))
        return int(at.timestamp())
    except ValueError:
        return 0


def authority_of(value: str | list[str] | None) -> int:
    return int(value) if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]{1,9}", value) and 1 <= int(value) <= 5 else 3


def fields(header: str | None) -> dict:
    raw = parse_header(header) if header else {}
    text = lambda k: raw[k] if isinstance(raw.get(k), str) else ""
    stamp = text("timestamp")
    return {
        "title": text("title"), "kind": text("kind") or text("type"), "description": text("description"), "authority": authority_of(raw.get("authority")),
        "timestamp": epoch(stamp) if stamp else 0, **{k: as_list(raw.get(k)) or [] for k in LISTS},
        "raw": [(k, {"text": v if isinstance(v, str) else None, "items": v if isinstance(v, list) else None}) for k, v in raw.items()],
    }


_RAW = pa.map_(pa.string(), pa.struct([("text", pa.string()), ("items", pa.list_(pa.string()))]))
_TYPE = pa.struct(
    [("title", pa.string()), ("kind", pa.string()), ("description", pa.string()), ("authority", pa.int32()), ("timestamp", pa.int64())]
    + [(k, pa.list_(pa.string())) for k in LISTS]
    + [("raw", _RAW)]
)
_SQL_TYPE = (
    "struct<title: string, kind: string, description: string, authority: int, timestamp: bigint, "
    + ", ".join(f"{k}: array<string>" for k in LISTS)
    + ", raw: map<string, struct<text: string, items: array<string>>>>"
)


def header_fields(header: Column) -> Column:
    """A struct of the page's fields, from its header."""

    def parse(headers: pa.Array) -> pa.Array:
        return pa.array([fields(h.as_py()) for h in headers], _TYPE)

    return F.arrow_udf(parse, _SQL_TYPE)(header)


def header_of(text: Column) -> Column:
    """The header's text; empty without one (CRLF files have none)."""
    return F.regexp_extract(text, HEADER, 1)


def body_of(text: Column) -> Column:
    """What follows the header, trimmed; the text itself where there is no header."""
    return F.when(F.regexp_like(text, F.lit(HEADER)), F.regexp_replace(F.regexp_replace(text, HEADER, ""), r"^\s+|\s+$", "")).otherwise(text)


def wikilinks(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def unquoted(s: str) -> str:
    """Trimmed, and without one pair of quotes that match."""
    s = s.strip()
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s


def note_fields(text: str) -> dict:
    """The stricter reading of source notes: title, description, tags and key_claims only; the header starts with `---` and ends at a line that starts so."""
    note: dict = {"title": "", "description": "", "tags": [], "key_claims": []}
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end < 0:
        return note
    filling: list[str] | None = None
    for raw in text[3:end].split("\n"):
        line = raw.rstrip(" \r")
        key, _, value = line.partition(":")
        value = value.strip()
        if key in ("title", "description"):
            note[key], filling = unquoted(value).strip(), None
        elif key in ("tags", "key_claims") and line.startswith(key + ":"):
            if value.startswith("["):
                parts = (unquoted(p).strip() for p in value.removeprefix("[").removesuffix("]").split(","))
                note[key], filling = note[key] + [p for p in parts if p], None
            else:
                filling = note[key]
        elif filling is not None and line.strip().startswith("-"):
            filling.append(unquoted(line.strip().removeprefix("-")))
        elif line and line[0] not in " \t":
            filling = None
    return note


def note_struct(text: Column) -> Column:
    """note_fields of the part of the text up to the header's end."""
    kind = pa.struct([("title", pa.string()), ("description", pa.string()), ("tags", pa.list_(pa.string())), ("key_claims", pa.list_(pa.string()))])

    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([note_fields(t.as_py() or "") for t in texts], kind)

    head = F.regexp_extract(text, r"(?s)^---.*?\n---", 0)
    return F.arrow_udf(parse, "struct<title: string, description: string, tags: array<string>, key_claims: array<string>>")(head)
