"""Text and scalar functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK = r"(?s)<think>(.*?)</think>"
#: Longer texts are left as they are.
THINK_LIMIT = 100_000
REFERENCE = r"(source_insight|note|source):([a-zA-Z0-9_]+)"


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def token_count(text: Column) -> Column:
    """1.3 tokens a word, cut to an integer: the rule that holds where no encoding file is at hand."""
    return F.floor(words(text) * F.lit(1.3).cast("double")).cast("long")


def token_cost(tokens: Column, per_million: float = 0.150) -> Column:
    return tokens / F.lit(1_000_000.0) * F.lit(per_million)


def remove_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "")


def remove_non_printable(text: Column) -> Column:
    """Special spaces become a space and line ends \\n, control characters go, the ends are trimmed; letters, numbers,
    white space and . , ! ? - _ stay. Fixed values: the classes of characters."""
    x = F.regexp_replace(text, r"[\u2000-\u200B\u202F\u205F\u3000]", " ")
    x = F.regexp_replace(x, r"[\u2028\u2029\r]", "\n")
    x = F.regexp_replace(x, r"[\p{C}&&[^\n\t]]", "")
    x = strip(F.regexp_replace(x, r"\u00A0", " "))
    return F.regexp_replace(x, r"[^\p{L}\p{N}_\s.,!?\-]", "")


def thinking(text: Column) -> Column:
    """What stands between <think> marks, blocks joined by an empty line; '' if there is none."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(THINK), F.lit(1)), strip)
    return F.when(text.isNull() | (F.length(text) > THINK_LIMIT), F.lit("")).otherwise(F.array_join(blocks, "\n\n"))


def without_thinking(text: Column) -> Column:
    """The text without its <think> blocks; unchanged if there is none."""
    cut = F.regexp_replace(F.regexp_replace(text, THINK, ""), r"\n\s*\n\s*\n", "\n\n")
    same = (F.length(text) > THINK_LIMIT) | ~F.regexp_like(text, F.lit(THINK))
    return F.when(text.isNull(), F.lit("")).when(same, text).otherwise(strip(cut))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def text_operation(text: Column, operation: str) -> Column:
    known = {"uppercase": F.upper, "lowercase": F.lower, "reverse": F.reverse, "word_count": lambda t: F.concat(F.lit("Word count: "), words(t))}
    if operation not in known:
        raise ValueError(f"unknown operation: {operation}")
    return known[operation](text)


def with_prefix(id: Column, table: str | Column) -> Column:
    """The id with its table's prefix, added if it is missing."""
    prefix = F.concat(F.lit(table) if isinstance(table, str) else table, F.lit(":"))
    return F.when(F.startswith(id, prefix), id).otherwise(F.concat(prefix, id))


def required(text: Column) -> Column:
    """Trimmed; null for what a check of required fields refuses."""
    return F.nullif(strip(text), F.lit(""))


def comma_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), strip)


def short(text: Column, chars: int = 100) -> Column:
    return F.substring(text, 1, chars)


def cut(text: Column, chars: int = 5000, mark: str = "...\n[Content truncated]") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(mark))).otherwise(text)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def parsed_time(text: Column) -> Column:
    """ISO 8601 texts as timestamps, null if they are none."""
    return F.try_to_timestamp(text)


def truthy(text: Column) -> Column:
    return F.lower(text).isin("true", "1", "yes", "on")


def repository_of(url: Column) -> Column:
    """owner and name of a code host's URL; null for other hosts or paths without both."""
    path = F.split(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", ""), "/")
    return F.when(F.try_parse_url(url, F.lit("HOST")).isin("github.com", "www.github.com") & (F.size(path) >= 2), F.struct(path[0].alias("owner"), path[1].alias("name")))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1. Epochs, then releases number by number, missing ones as 0; a < b < rc < none < post; dev before all;
    then local parts after `+`: none before any, words before numbers."""
    plain = lambda v: F.regexp_replace(F.lower(strip(v)), "^v", "")
    release = lambda v: F.transform(F.split(F.regexp_extract(plain(v), r"^(?:\d+!)?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("long"))

    def key(v: Column, width: Column) -> Column:
        numbers = F.concat(release(v), F.array_repeat(F.lit(0).cast("long"), width - F.size(release(v))))
        v, local = F.substring_index(plain(v), "+", 1), F.when(F.contains(plain(v), F.lit("+")), F.substring_index(plain(v), "+", -1))
        number = lambda p: F.coalesce(F.nullif(F.regexp_extract(v, p, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
        stage = F.when(F.regexp_like(v, F.lit(r"\d[._-]?(a|alpha)[._-]?\d*")), 1).when(F.regexp_like(v, F.lit(r"\d[._-]?(b|beta)[._-]?\d*")), 2).when(F.regexp_like(v, F.lit(r"\d[._-]?(rc|c|pre|preview)[._-]?\d*")), 3)
        stage = F.coalesce(stage, F.when(F.regexp_like(v, F.lit("dev")), 0).when(F.regexp_like(v, F.lit("post")), 5).otherwise(4))
        part = lambda x: F.struct(x.try_cast("long").isNotNull().alias("number"), F.coalesce(x.try_cast("long"), F.lit(0).cast("long")).alias("n"), F.when(x.try_cast("long").isNull(), x).otherwise(F.lit("")).alias("t"))
        locals_ = F.transform(F.split(local, "[._-]"), part)
        return F.struct(
            number(r"^(\d+)!").alias("epoch"), numbers.alias("release"), stage.cast("long").alias("stage"), number(r"(?:a|alpha|b|beta|rc|c|preview|pre)[._-]?(\d+)").alias("pre"), number(r"post[._-]?(\d+)").alias("post"),
            F.when(F.regexp_like(v, F.lit("dev")), 0).otherwise(1).alias("final"), number(r"dev[._-]?(\d+)").alias("dev"), F.coalesce(locals_, F.array().cast("array<struct<number:boolean,n:bigint,t:string>>")).alias("local"),
        )

    width = F.greatest(F.size(release(a)), F.size(release(b)))
    x, y = key(a, width), key(b, width)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def route_model(tokens: Column, explicit: Column, default: Column, large: Column, limit: int = 105_000) -> Column:
    """The large-context model beyond `limit` tokens, else the one asked for, else the default."""
    return F.when(tokens > limit, large).otherwise(F.coalesce(explicit, default))


def _bound(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Neighbours that are added up one by one; before them whole groups are.
_GROUP = 64


def _sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it, in two steps: over groups, then inside a group."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _GROUP).cast("int")), lambda g: total(F.slice(sizes, g * _GROUP + 1, _GROUP)))
    starts = F.aggregate(groups, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    group = lambda i: F.floor(i / _GROUP).cast("int")
    return _bound(starts, lambda s: F.transform(sizes, lambda _, i: F.get(s, group(i)) + total(F.slice(sizes, group(i) * _GROUP + 1, i % _GROUP))))


def citations(text: Column) -> Column:
    """Array of (type, id, key, start, end) of the references in a text, in order; places count from 0."""
    keys, gaps = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), F.split(text, REFERENCE, -1)
    none = F.array().cast("array<struct<type:string,id:string,key:string,start:int,end:int>>")

    def placed(keys: Column) -> Column:
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(keys)).alias("gap"), keys.alias("key"))
        sized = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["key"].alias("key"), (F.length(p["gap"]) + F.length(p["key"])).alias("all")))

        def reference(p: Column, before: Column) -> Column:
            first = before + p["gap"]
            return F.struct(F.substring_index(p["key"], ":", 1).alias("type"), F.substring_index(p["key"], ":", -1).alias("id"), p["key"].alias("key"), first.cast("int").alias("start"), (first + F.length(p["key"])).cast("int").alias("end"))

        return _bound(sized, lambda x: F.zip_with(x, _bound(F.transform(x, lambda p: p["all"]), _sums_before), reference))

    return _bound(keys, lambda k: F.when(F.size(k) > 0, placed(k)).otherwise(none))


def _rewritten(text: Column, pattern: str, link) -> Column:
    """text with each match of pattern replaced by link(match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.transform(found, link), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


_ANY = r"(?:source_insight|note|source):[a-zA-Z0-9_]+"
_KEY = f"({_ANY})"


def numbered_citations(text: Column) -> Column:
    """References become [n](#ref-type-id), numbered by first use, brackets around them taken in; the list follows."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    href = lambda key: F.concat(F.lit("(#ref-"), F.replace(key, F.lit(":"), F.lit("-")), F.lit(")"))

    def numbered(order: Column) -> Column:
        def link(m):
            key = F.regexp_extract(m, _KEY, 1)
            return F.concat(F.lit("["), F.array_position(order, key).cast("string"), F.lit("]"), href(key))

        body = _rewritten(text, rf"\[\[{_ANY}\]\]|\[{_ANY}\]|{_ANY}", link)
        listed = F.transform(order, lambda key, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] - ["), key, F.lit("]"), href(key)))
        return F.when(F.size(order) > 0, F.concat(body, F.lit("\n\nReferences:\n"), F.array_join(listed, "\n"))).otherwise(text)

    return _bound(found, numbered)


def linked_citations(text: Column) -> Column:
    """References become links that show them as they stand, brackets and bold marks included; ids over 100 characters stay."""
    href = lambda m: F.concat(F.lit("(#ref-"), F.replace(F.regexp_extract(m, _KEY, 1), F.lit(":"), F.lit("-")), F.lit(")"))
    one = r"(?:source_insight|note|source):[a-zA-Z0-9_]{1,100}(?![a-zA-Z0-9_])"
    pattern = rf"\[\[{one}\]\]|\[{one}\]|\[\*\*{one}\*\*\]|\*\*{one}\*\*|{one}"
    return _rewritten(text, pattern, lambda m: F.concat(F.lit("["), m, F.lit("]"), href(m)))


def json_array(text: Column, schema: str = "array<string>") -> Column:
    """A JSON list as an array; null for no text, an error for text that is no JSON list."""
    x = F.from_json(text, schema, {"mode": "FAILFAST"})
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(x.isNull(), F.raise_error(F.concat(F.lit("invalid JSON: "), text)).cast(schema)).otherwise(x)


def whole_json(*columns: str) -> Column:
    """A row, with the structs inside it, as one JSON text; null fields are left out."""
    return F.to_json(F.struct(*columns))


def briefing(default: Column, suffix: Column) -> Column:
    """The default briefing, and the additional instructions if there are any."""
    more = F.when(suffix.isNotNull() & (suffix != ""), F.concat(F.lit("\n\nAdditional instructions: "), suffix))
    return F.concat(default, F.coalesce(more, F.lit("")))


#: Letters whose capital is more than one character in Unicode's full mapping, each with the one that its simple mapping gives.
_SIMPLE_UPPER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def upper_each(c: Column) -> Column:
    """Each character in upper case by itself, as SQL has it: a text stays as long as it is (F.upper makes SS of one letter)."""
    simple = F.create_map(*[F.lit(x) for pair in _SIMPLE_UPPER.items() for x in pair])
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(simple[x], F.upper(x))), "")
    return F.when(F.regexp_like(c, F.lit(f"[{''.join(_SIMPLE_UPPER)}]")), each).otherwise(F.upper(c))


def rendered(template: str, **values: Column) -> Column:
    """The template with each {{name}} replaced by its value, null as ''; what a value holds is not read again."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        if m[1] not in values:
            raise ValueError(f"no value for {m[1]}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def among(value: Column, allowed: tuple[str, ...], what: str = "value") -> Column:
    """The value, or an error if it is none of the allowed ones; null stays."""
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), value)))
