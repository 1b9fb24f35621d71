"""Text matching and clean-up expressions (built-in functions only)."""

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities of HTML that end with a semicolon, from Python's own table.
_NAMED = json.dumps({f"&{name}": text for name, text in html5.items() if name.endswith(";")})
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
REPLACEMENT = "�"
_WESTERN = json.dumps({f"{n:X}": bytes([n]).decode("cp1252", "replace").replace(REPLACEMENT, chr(n)) for n in range(128, 160)})


def has_any(text: Column, terms: list[str]) -> Column:
    """True if any term occurs as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def hit_count(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def hits(text: Column, terms: list[str]) -> Column:
    """Terms that occur, in code-point order."""
    return F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in sorted(terms)]))


def first_match(text: Column, groups: list[tuple[str, list[str]]], default: str) -> Column:
    chain = None
    for label, terms in groups:
        test = has_any(text, terms)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(default))


def repository_text(repo: Column, description: Column, topics: Column) -> Column:
    return F.lower(F.concat_ws(
        " ", F.coalesce(repo, F.lit("")), F.coalesce(description, F.lit("")),
        F.coalesce(F.array_join(topics, " "), F.lit(""))))


def distinct_head(values: Column, n: int | None = None) -> Column:
    """Ordered distinct values; with ``n``, the first ones for display."""
    return F.array_distinct(values) if n is None else F.slice(F.array_distinct(values), 1, n)


def code_point(hexadecimal: Column) -> Column:
    """The character of a code point; what is none, or is zero or half of a pair, gives the replacement character.

    The numbers 128 to 159 mean the letters that Windows-1252 has there, as in HTML.
    """
    digits = F.regexp_replace(F.upper(hexadecimal), "^0+", "")
    wide = F.lpad(digits, 8, "0")
    usable = (F.length(digits).between(1, 5) | (digits.rlike("^10[0-9A-F]{4}$"))) & ~digits.rlike("^D[89A-F][0-9A-F]{2}$")
    western = F.when(digits.rlike("^[89][0-9A-F]$"), F.element_at(F.from_json(F.lit(_WESTERN), "map<string,string>"), digits))
    return F.coalesce(western, F.when(usable, F.decode(F.unhex(wide), "UTF-32")), F.lit(REPLACEMENT))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal character references in one pass; unknown names stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){_ENTITY}|[^&]+|&"), F.lit(0))

    def piece(p):
        decimal = F.regexp_extract(p, "^&#0*([0-9]{1,9});$", 1)
        number = F.when(decimal != "", F.conv(decimal, 10, 16)).otherwise(F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+);$", 1))
        named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), p)
        return (F.when(~F.startswith(p, F.lit("&")) | (F.length(p) == 1), p).when(F.startswith(p, F.lit("&#")), code_point(number))
                .otherwise(F.coalesce(named, p)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def clean_title(raw: Column) -> Column:
    text = decode_entities(F.coalesce(raw, F.lit("")))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.filter(F.split(text, " / "), lambda p: F.trim(p) != "")
    first, last = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.size(parts) - 1))
    take_last = (
        F.contains(text, F.lit(" / ")) & F.contains(first, F.lit(REPLACEMENT))
        & ~F.contains(last, F.lit(REPLACEMENT)))
    return F.when(F.coalesce(take_last, F.lit(False)), last).otherwise(
        F.trim(F.replace(text, F.lit(REPLACEMENT), F.lit(""))))


def search_normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[-_/]+", " ")


def query_tokens(text: Column) -> Column:
    """Latin runs of two or more characters, then punctuation-split chunks, distinct in order."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("([a-z0-9+#.]{2,})"), F.lit(1))
    chunks = F.filter(F.split(low, "[\\s，。,.、/：:；;（）()]+"), lambda t: F.length(t) > 1)
    return F.array_distinct(F.concat(latin, chunks))


def feature_normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def bounded(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def filled(value: Column, kind: str = "string") -> Column:
    """A required field counts as present unless it is null, '' or an empty array."""
    if kind == "array":
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull() & (value != "") if kind == "string" else value.isNotNull()
