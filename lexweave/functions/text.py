"""Text columns: tokens, token classes, numbering, markup, entities, characters and n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"
NUMBERING = "b c d f g h j k l m n q r ii iii iv v vi vii viii ix x".split()
METADATA = "script style head title nav footer noscript template".split()
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "eacute": "é", "egrave": "è", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "ndash": "–", "mdash": "—", "hellip": "…"}
CATEGORIES = ("Ll", "Lu", "Lo", "Nd", "Po", "Pd", "Ps", "Pe", "Zs", "Sm", "Sc", "Pi", "Pf", "Cc")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and _, and every other character that is no space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_alpha(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$")


def is_numeric(t: Column) -> Column:
    return t.rlike(r"^\p{N}+$")


def is_mixed(t: Column) -> Column:
    return t.rlike(r"^[\p{L}\p{N}]+$") & ~is_alpha(t) & ~is_numeric(t)


def number_set(toks: Column) -> Column:
    """Numbering labels in lower case, numbers, and mixed tokens: what a segment's translation should share."""
    labels = F.array_intersect(F.transform(toks, F.lower), F.array(*map(F.lit, NUMBERING)))
    return F.array_union(labels, F.filter(toks, lambda t: is_numeric(t) | is_mixed(t)))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection by the smaller size; null where one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)))


def delete_elements(text: Column, names: list[str] = METADATA) -> Column:
    for n in names:
        text = F.regexp_replace(text, rf"(?is)<{n}[^>]*>.*?</{n}>", "")
    return text


def replace_tags(text: Column) -> Column:
    """Processing instructions, comments and block tags to line ends, cells to |, other tags to nothing."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"<[?!][^>]*>", "\n"), (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|body|html|br)(?:\s[^>]*)?/?>", "\n"), (r"(?i)</?t[dh](?:\s[^>]*)?>", "|"), (r"<[^>]*>", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `value` is worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_entities(text: Column) -> Column:
    """Known names and hexadecimal or decimal code points; & last."""
    return once(once(text, _hexadecimals), _decimals_and_names)


def _hexadecimals(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#[xX]([0-9A-Fa-f]{1,6});"), F.lit(1)))
    char = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    return F.aggregate(found, text, lambda s, h: F.replace(F.replace(s, F.concat(F.lit("&#x"), h, F.lit(";")), char(h)), F.concat(F.lit("&#X"), h, F.lit(";")), char(h)))


def _decimals_and_names(text: Column) -> Column:
    char = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    decimals = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,7});"), F.lit(1)))
    known = F.filter(decimals, lambda d: d.cast("int") <= 0x10FFFF)
    text = F.aggregate(known, text, lambda s, d: F.replace(s, F.concat(F.lit("&#"), d, F.lit(";")), char(F.hex(d.cast("int")))))
    for name, to in sorted(ENTITIES.items(), key=lambda e: e[0] == "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(to))
    return text


def normalise_space(text: Column) -> Column:
    for pattern, to in ((r"\p{Zs}+", " "), (r" ?\n\s+", "\n"), (r"(\p{Ll}):(\p{L})", "$1: $2"), (r"^\n", ""), (r" \n", "\n"), (r"(?m)^[| ]+\n", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def year_of(name: Column) -> Column:
    """The year in a file's name: its last four digits that stand alone, null without."""
    found = F.regexp_extract_all(name, F.lit(r"(?<![0-9])[0-9]{4}(?![0-9])"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def category(char: Column) -> Column:
    """0..13 for the listed Unicode categories, else 14."""
    out = F.lit(14)
    for k, name in reversed(list(enumerate(CATEGORIES))):
        out = F.when(char.rlike(rf"^\p{{{name}}}"), k).otherwise(out)
    return out


def ngrams(word: Column, low: int = 4, high: int = 6) -> Column:
    """n-grams of <word>, repeats kept, for n below its length."""
    w = F.concat(F.lit("<"), word, F.lit(">"))

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.length(w) > n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def insert_at(word: Column, positions: Column, char: str = "#") -> Column:
    """`char` before each of the ascending 0-based positions."""
    ends = F.concat(positions, F.array(F.length(word)))
    begins = F.concat(F.array(F.lit(0)), positions)
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(word, a + 1, b - a)), char)
