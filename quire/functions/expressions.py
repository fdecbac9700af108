"""Row-level normalisers as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of commands and signs in formulas, command symbols, and terms of each notation profile.
COMMANDS = {
    "": ("left", "right", "big", "Big", "bigg", "Bigg", "quad", "qquad"), r"\frac": ("dfrac", "tfrac"), "·": ("cdot",), "×": ("times",),
    "≤": ("le", "leq"), "≥": ("ge", "geq"), "≠": ("ne", "neq"),
}
SIGNS = {"": (r"\,", r"\;", r"\:", r"\!", r"\>", r"\ ", "~", "$"), "-": ("−", "–")}
TEXT_COMMANDS = (r"\mathrm", r"\mathit", r"\text", r"\operatorname")
SYMBOLS = ((r"\alpha", "α"), (r"\beta", "β"), (r"\gamma", "γ"), (r"\pi", "π"), (r"\infty", "∞"), (r"\sqrt", "√"), (r"\angle", "∠"), (r"\perp", "⊥"), (r"\parallel", "∥"), (r"\cdot", "·"))
NOTATION = {"mean": r"\\mu|\\bar\{x\}|x̄", "deviation": r"\\sigma|\bSD\b|\bs\b", "variance": r"\\sigma\^2|s\^2|\bVar\b"}
PROFILES = {"greek": ((r"\\bar\{x\}|x̄", "\\\\mu"), (r"s\^2", "\\\\sigma^2"), (r"\bSD\b", "\\\\sigma")), "latin": ((r"\\mu", "x̄"), (r"\\sigma\^2", "s^2"), (r"\\sigma", "s"))}


def _chain(text: Column, rules) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def word(text: Column) -> Column:
    """SC-01: without marks and quotes around and inside, vowel points and the quote marks of abbreviations included."""
    return F.lower(F.regexp_replace(text, r"[.,;:!?\"'()\[\]*#$%&\u0591-\u05C7\u05F3\u05F4]", ""))


def number(text: Column) -> Column:
    """SC-02: thousands joined if the commas part groups of three, else a comma is a point. A comma may stand in braces."""
    text = F.replace(text, F.lit("{,}"), F.lit(","))
    return F.when(text.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$"), F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))


_MATH_TOKEN = r"\\[A-Za-z]+|\\.|[^\\]"


def _spelled(token: Column) -> Column:
    """A token of a formula in its canonical spelling; empty for white space, spacing and size commands and the marks around."""
    pairs = [(f"\\{name}", to) for to, names in COMMANDS.items() for name in names] + [(sign, to) for to, signs in SIGNS.items() for sign in signs]
    table = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return F.when(token.rlike(r"^\s$"), "").otherwise(F.coalesce(F.try_element_at(table, token), token))


def maths(text: Column) -> Column:
    """SC-03: one spelling of a formula, printed in one pass over its tokens (commands, signs, letters, braces).

    A group is printed when it closes: without braces if it is one sign, or if a text command stands before it, else as it
    is; a group with another inside keeps its braces. Full stops and commas at the end go. Null stays null.
    """
    state = F.struct(F.lit("").alias("out"), F.lit("").alias("command"), F.lit(None).cast("string").alias("group"))

    def put(s: Column, piece: Column, command=None) -> Column:
        """The state with a piece added to the open group, or to the formula after a text command that had no group."""
        command = F.lit("") if command is None else command
        out = F.when(s["group"].isNull(), F.concat(s["out"], s["command"], piece)).otherwise(s["out"])
        kept = F.when(s["group"].isNull(), command).otherwise(s["command"])
        return F.struct(out.alias("out"), kept.alias("command"), F.when(s["group"].isNotNull(), F.concat(s["group"], piece)).alias("group"))

    def step(s: Column, token: Column) -> Column:
        flushed = F.concat(s["out"], F.when(s["group"].isNotNull(), F.concat(s["command"], F.lit("{"), s["group"])).otherwise(""))
        nested = F.struct(flushed.alias("out"), F.when(s["group"].isNull(), s["command"]).otherwise("").alias("command"), F.lit("").alias("group"))
        bare = (s["command"] != "") | ((F.length(s["group"]) == 1) & (s["group"] != "\\"))
        closed = F.concat(s["out"], F.when(bare, s["group"]).otherwise(F.concat(F.lit("{"), s["group"], F.lit("}"))))
        shut = F.struct(closed.alias("out"), F.lit("").alias("command"), F.lit(None).cast("string").alias("group"))
        opens_text = s["group"].isNull() & token.isin(*TEXT_COMMANDS)
        inside_text = s["group"].isNotNull() & token.isin(*TEXT_COMMANDS)
        # a text command within a group begins a new innermost group: what was open can't lose its braces any more
        inner = F.struct(flushed.alias("out"), token.alias("command"), F.lit(None).cast("string").alias("group"))
        return (
            F.when(token == "", s).when(token == "{", nested).when((token == "}") & s["group"].isNotNull(), shut)
            .when(opens_text, put(s, F.lit(""), token)).when(inside_text, inner).otherwise(put(s, token))
        )

    spelled = F.transform(F.regexp_extract_all(text, F.lit(_MATH_TOKEN), F.lit(0)), _spelled)
    end = F.aggregate(spelled, state, step)
    printed = F.concat(end["out"], end["command"], F.when(end["group"].isNotNull(), F.concat(F.lit("{"), end["group"])).otherwise(""))
    return F.when(text.isNotNull(), F.rtrim(printed, F.lit(".,")))


def tokens(text: Column) -> Column:
    """SC-04: array of tokens: whole formulas between double or single dollars, and words, parted by the hyphen mark too."""
    return F.regexp_extract_all(text, F.lit(r"\$\$[^$]+\$\$|\$[^$]+\$|[^\s$\u05BE]+"), 0)


def token_kind(token: Column) -> Column:
    """SC-04: M for a formula, W for a word."""
    return F.when(token.rlike(r"^\$\$?[^$]+\$\$?$"), "M").otherwise("W")


_DIGITS = r"[0-9]+(?:[.][0-9]+)?"
_COORDINATES = rf"\(\s*-?{_DIGITS}(?:\s*,\s*-?{_DIGITS}){{1,2}}\s*\)"
_THOUSANDS = r"(?<![0-9.])[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])"
_SIGNED = rf"(?:(?<![\p{{L}}\p{{N}})\]}}])-)?{_DIGITS}"


def numbers_in(text: Column) -> Column:
    """SC-05: array of the numbers in a text, in one scan from left to right: two or three numbers in round brackets are
    coordinates, each a number; commas between groups of three are thousands; a minus counts only where no operand (letter,
    digit or closing bracket) stands before it. Long dashes are minus signs."""
    found = F.regexp_extract_all(F.translate(text, "−–", "--"), F.lit(f"{_COORDINATES}|{_THOUSANDS}|{_SIGNED}"), F.lit(0))
    parts = lambda x: F.when(F.startswith(x, F.lit("(")), F.regexp_extract_all(x, F.lit(f"-?{_DIGITS}"), F.lit(0))).otherwise(F.array(F.replace(x, F.lit(","), F.lit(""))))
    return F.flatten(F.transform(found, parts))


#: What a leading label may be: the bracket before it, its kind and the mark after it.
LABEL_KINDS = {"number": "[0-9]+", "short": "[0-9]{1,2}", "roman": "[IVX]+", "latin": "[a-z]", "hebrew": "[א-ת]"}
LABELS = (("(", "number", ")"), ("", "short", "."), ("", "short", ")"), ("", "roman", "."), ("", "latin", ")"), ("", "hebrew", "."))


def strip_label(text: Column) -> Column:
    """SC-06: without a leading label such as (3), 3., a), IV. or a Hebrew letter: the first word is taken apart into bracket,
    body and mark, and goes with the white space around if LABELS has such a one."""
    first = F.ltrim(text, F.lit(" \t\n\r\f\x0b"))
    opening = F.when(F.startswith(first, F.lit("(")), "(").otherwise("")
    body = F.regexp_extract(first, r"^\(?([\p{L}\p{N}]+)", 1)
    mark = F.substring(first, F.length(opening) + F.length(body) + 1, F.lit(1))
    known = reduce(lambda x, y: x | y, ((opening == o) & body.rlike(f"^{LABEL_KINDS[kind]}$") & (mark == m) for o, kind, m in LABELS))
    rest = F.substring(first, F.length(opening) + F.length(body) + 2, F.length(first))
    return F.when(known, F.ltrim(rest, F.lit(" \t\n\r\f\x0b"))).otherwise(text)


def section_id(text: Column) -> Column:
    """SC-07: without brackets, dots and spaces around; lower case."""
    return F.lower(F.regexp_replace(F.trim(text), r"^[\s().:\[\]]+|[\s().:\[\]]+$", ""))


def label_key(text: Column) -> Column:
    """SC-08: cell text, labels and categories: single spaces, lower case, no edges."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def points_text(points: Column) -> Column:
    """SC-10: two decimals, half up, without trailing zeros."""
    cents = F.round(points.cast("decimal(38,9)"), 2).cast("decimal(18,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(cents, r"0+$", ""), r"[.]$", "")


def safe_double(text: Column, default: float) -> Column:
    """SC-10: a number; the default for none and for NaN."""
    value = text.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), default).otherwise(value)


def break_markers(text: Column) -> Column:
    """SC-11: a line for each flattened marker."""
    return F.regexp_replace(text, r"([^\n]) +(\([0-9]+\))", "$1\n$2")


def plain_symbols(text: Column) -> Column:
    """SC-12: commands as the symbols they stand for; the rest of the commands and braces go."""
    known = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SYMBOLS, text)
    return F.regexp_replace(F.regexp_replace(known, r"\\[a-zA-Z]+", ""), r"[{}]", "")


def renotate(text: Column, profile: str) -> Column:
    """SC-13: the terms of a profile in place of the other's."""
    return _chain(text, PROFILES[profile])


def notation_issues(text: Column) -> Column:
    """SC-13: array of the quantities that a text names in more than one way."""
    several = [F.when(F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0))) > 1, name) for name, p in NOTATION.items()]
    return F.filter(F.array(*several), lambda x: x.isNotNull())


def to_pairs(column: Column) -> Column:
    """SC-14: a map as an array of (key, value)."""
    return F.map_entries(column)


def from_pairs(column: Column) -> Column:
    """SC-14: the map again."""
    return F.map_from_entries(column)


def fenced_json(text: Column, schema: str) -> Column:
    """SC-15: the parsed object of a text that may stand between code fences; null fields where it is broken."""
    return F.from_json(F.regexp_replace(text, r"^\s*```[a-z]*\s*|\s*```\s*$", ""), schema)


def undeclared(expression: Column, declared: Column) -> Column:
    """SC-16: letters used in an expression, commands apart, that aren't declared."""
    letters = F.array_distinct(F.regexp_extract_all(F.regexp_replace(expression, r"\\[a-zA-Z]+", " "), F.lit("[a-zA-Z]"), 0))
    return F.array_sort(F.array_except(letters, declared))


def dot(a: Column, b: Column) -> Column:
    """SC-17."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """SC-17."""
    return F.sqrt(dot(a, a))


def angle(a: Column, b: Column) -> Column:
    """SC-17: in degrees; null for a zero vector."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))))))


def parallel(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """SC-17."""
    return F.abs(F.abs(dot(a, b)) - norm(a) * norm(b)) <= tolerance


def coerced(column: Column, kind: str) -> Column:
    """SC-18: bad numbers become null, missing text empty, missing flags false."""
    if kind == "number":
        return column.try_cast("double")
    return F.coalesce(column.cast("string"), F.lit("")) if kind == "text" else F.coalesce(column.try_cast("boolean"), F.lit(False))
