"""Column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: ASCII, the separators U+001C to U+001F, U+0085 and all Unicode space, line and paragraph separators.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def trim_any(c: Column) -> Column:
    """`c` without white space of any kind at its ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def reference_key(c: Column) -> Column:
    """A link value cut at its first `#`, then trimmed."""
    return trim_any(F.substring_index(c, "#", 1))


def slug(page_id: Column) -> Column:
    """The last path segment without `.md`, lower-cased, with blanks turned into `-`."""
    stem = F.regexp_replace(F.substring_index(page_id, "/", -1), r"\.md$", "")
    return F.replace(F.lower(stem), F.lit(" "), F.lit("-"))


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


#: Words that name the type of an entity, and what marks a tag as noise.
ENTITY_TYPES = ("技术", "概念", "组织", "人物", "产品", "项目", "地点")
ARTEFACTS = ("nbsp", "sources", "pattern", "from", "wiki", "tag", "type", "true", "false", "null")
NOISE = r"(?i)https?://|mmbiz|appmsg|wx_fmt|chksm|bizuin|^http|^nbsp$|^sources$|^pattern$|^from$|^wiki\]$|^\["
ENTITY = r"【([^|】]+)\|([^】]+)】"
LONGEST_TAG = 20


def entity_names(claim: Column) -> Column:
    return F.regexp_extract_all(claim, F.lit(ENTITY), F.lit(1))


def normal_tag(tag: Column) -> Column:
    """Trimmed; an all lower-case tag that starts with an ASCII letter gets a capital."""
    t = trim_any(tag)
    plain = (t == F.lower(t)) & F.regexp_like(t, F.lit("^[a-zA-Z]"))
    return F.when(plain, F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))).otherwise(t)


def noisy_tag(tag: Column) -> Column:
    return (
        (F.length(tag) < 2) | (F.length(tag) > LONGEST_TAG) | tag.isin(*ENTITY_TYPES) | tag.isin(*ARTEFACTS) | F.regexp_like(tag, F.lit(NOISE))
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def plain_title(path: Column) -> Column:
    """The stem with blanks for dashes."""
    return F.replace(stem(path), F.lit("-"), F.lit(" "))


def display_title(path: Column) -> Column:
    """The stem with blanks for dashes and underscores, single-spaced, each word with a capital."""
    words = F.filter(F.split(F.translate(stem(path), "-_", "  "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def layer(path: Column) -> Column:
    """The first path segment if it is a layer, else raw."""
    first = F.substring_index(path, "/", 1)
    return F.when(first.isin("raw", "wiki", "schema") & F.contains(path, F.lit("/")), first).otherwise("raw")


def topic_slug(topic: Column) -> Column:
    """Lower-case letters and digits, other runs as one dash, at most 80 characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(topic), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")
    return F.substring(s, 1, 80)


def import_slug(value: Column) -> Column:
    """Lower-case ASCII letters, digits and Han characters, other runs as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim_any(value)), r"[^a-z0-9\x{4E00}-\x{9FFF}]+", "-"), "^-+|-+$", "")


def safe_id(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")


def normal_url(value: Column) -> Column:
    """The address in parentheses if there is one; without slashes at its end; lower-case."""
    v = trim_any(value)
    inner = F.regexp_extract(v, r"\((https?://[^)]+)\)", 1)
    return F.lower(F.regexp_replace(F.when(inner != "", inner).otherwise(v), "/+$", ""))


def normal_text(value: Column) -> Column:
    return F.lower(trim_any(F.regexp_replace(value, f"{SPACE}+", " ")))


def topic_id(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(value, r"/topic/(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def clean_cell(value: Column) -> Column:
    return F.coalesce(trim_any(F.translate(value, "\t\r\n", "   ")), F.lit(""))


def token_set(text: Column) -> Column:
    """Distinct lower-case words of two or more characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda w: F.length(w) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where either is empty or null."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / union).otherwise(0.0)


def without_fences(text: Column) -> Column:
    """A fenced answer without its fences; other text trimmed."""
    t = F.trim(text)
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*?)\n?```$", 1)
    return F.when(F.regexp_like(t, F.lit(r"(?s)^```[^\n]*\n.*```$")), F.trim(inner)).otherwise(t)


#: What marks a line of a technical catalogue.
CATALOGUE_ENTRY, CATALOGUE_TABLE = r"\bM\d{2}\b", r"(?i)(iceberg_|dim_|dwd_|hive_|matrixdb|\.im_edge\.)"


def technical_catalogue(content: Column) -> Column:
    """At least 50 lines, and 5 with numbered entries, or 10 with names of tables, or 30 % table rows."""
    lines = F.split(content, "\n")
    having = lambda p: F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(p))))
    return (F.size(lines) >= 50) & ((having(CATALOGUE_ENTRY) >= 5) | (having(CATALOGUE_TABLE) >= 10) | (having(r"^\s*\|") / F.size(lines) >= 0.3))


def source_count(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"(?m)^source_count:\s*(\d+)", 1).try_cast("int"), F.lit(0))


def with_source_count(text: Column, add: Column) -> Column:
    """The count raised by `add`; a page without one gets it after its opening line."""
    line = F.concat(F.lit("source_count: "), source_count(text) + add)
    first = F.regexp_extract(text, r"(?s)^(.*?---\n)", 1)
    inserted = F.when(first != "", F.concat(first, line, F.lit("\n"), F.substr(text, F.length(first) + 1))).otherwise(text)
    has = F.regexp_like(text, F.lit(r"(?m)^source_count:\s*\d+"))
    return F.when(has, F.regexp_replace(text, F.lit(r"(?m)^source_count:\s*\d+"), line)).otherwise(inserted)


def note_hash(title: Column, description: Column, path: Column, tags: Column, claims: Column) -> Column:
    """SHA-256 over the note's fields, each ended by a zero; claims are marked."""
    end = F.lit("\u0000")
    text = lambda c: F.concat(F.coalesce(c, F.lit("")), end)
    items = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), text), "")
    marked = F.array_join(F.transform(F.coalesce(claims, F.array().cast("array<string>")), lambda c: F.concat(F.lit("claim:"), text(c))), "")
    return F.sha2(F.concat(text(title), text(description), text(path), items, marked), 256)


def note_title(note: Column, fallback: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_extract(note, r"(?m)^title:[ \t]*(.*)$", 1), "[\"']", ""))
    return F.when(t != "", t).otherwise(fallback)


def truncated(content: Column, limit: int = 5000) -> Column:
    """The content up to `limit` UTF-8 bytes, cut back to a whole character. Character counts bound byte counts, so only what may be too long is cut byte-wise."""
    raw = F.encode(content, "UTF-8")
    starts = lambda n: F.hex(F.substring(raw, n, 1)).between("80", "BF")
    cut = F.when(~starts(limit + 1), limit).when(~starts(limit), limit - 1).when(~starts(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(content) > limit, F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")).otherwise(content)
