"""Tokens and other text columns."""

from collections import Counter

from pyspark.sql import Column, functions as F

from recollect.functions.constants import PREVIEW, STOPWORDS

#: bytes.translate table: lower-cases A-Z and turns all but ASCII letters and digits into blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: Column | str) -> Column:
    """Runs of ASCII letters and digits, lower-cased one by one, without stopwords; repeats stay."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(STOPWORDS))


def token_counts(text: bytes | None) -> Counter[str]:
    """The ``tokens`` of a text in UTF-8, and how often it has them."""
    found = Counter((text or b"").translate(PLAIN).decode("ascii").split())
    for word in STOPWORDS:
        found.pop(word, None)
    return found


def overlap(query: Column, document: Column) -> Column:
    """The share of query tokens, repeats counted, that the document has."""
    return F.size(F.filter(query, lambda t: F.array_contains(document, t))).cast("double") / F.greatest(F.lit(1), F.size(query))


def preview(text: Column, size: int = PREVIEW) -> Column:
    return F.substring(text, 1, size)


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three of them dots where something is cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def fixed(x: Column, digits: int) -> Column:
    """A fixed number of digits, rounded by the exact value of the double (half to even), as C's printf does; format_string rounds its shortest decimal form, half up."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def duration(us: Column) -> Column:
    """Microseconds for people: us, ms or s."""
    return F.when(us < 1000, F.concat(fixed(us, 1), F.lit(" us"))).when(us < 1_000_000, F.concat(fixed(us / 1000, 2), F.lit(" ms"))).otherwise(F.concat(fixed(us / 1_000_000, 2), F.lit(" s")))


def named(code: Column, names: list[str]) -> Column:
    """The name of a whole-number code; ``unknown`` beyond the list."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), (code + 1).cast("int")), F.lit("unknown"))
