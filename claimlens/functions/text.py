"""Text functions as Column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode white space, and the four separators that other regex dialects count too.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Greek letters and their names, in alphabetical order; upper case and final
# sigma are folded to the lower-case letter first.
GREEK_UPPER = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩς"
GREEK_FOLDED = "αβγδεζηθικλμνξοπρστυφχψωσ"
GREEK_NAMES = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
).split()

# Replacements applied in this order.
CHARACTER_MAPPINGS = {"+/-": "±", "+-": "±", "CO2": "CO₂", "H2O": "H₂O", "O2": "O₂", "N2": "N₂"}

# English function words that say nothing about a quote's content.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare "
    "and or but if then else when where why how what which who whom this that these those am to of in for on with at by "
    "from as into through during before after above below between under again further once here there all each few more most other "
    "some such no nor not only own same so than too very just also now its it"
).split()


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """Greek letters by name, lower case, each run of other than letters, numbers and _ one space, trimmed."""
    # One pass over the pieces between Greek letters, however many kinds of them there are.
    names = F.create_map(*[F.lit(x) for pair in zip(GREEK_FOLDED, GREEK_NAMES, strict=False) for x in pair])
    letters = "".join(dict.fromkeys(GREEK_FOLDED))
    pieces = F.regexp_extract_all(F.translate(text, GREEK_UPPER, GREEK_FOLDED), F.lit(f"[{letters}]|[^{letters}]+"), F.lit(0))
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(names, p), p)), "")
    greek = F.when(text.rlike("[Α-Ωα-ω]"), spelled).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(greek), r"[^\p{L}\p{N}_]+", " "))


def normalize_whitespace(text: Column) -> Column:
    """White space collapsed, lower case; punctuation stays."""
    return F.lower(collapse(text))


def split_query(text: Column, literal_brackets: Sequence[str] = ()) -> Column:
    """Parts of a quote between ellipses, without editorial [brackets].

    A bracket stays whole if its content matches one of `literal_brackets`. Array, empty if
    nothing is left."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\[[^\n]*?\]|[^\[]+|\[)"), F.lit(1))

    def keep(piece: Column) -> Column:
        bracket = piece.startswith("[") & piece.endswith("]") & (F.length(piece) > 1)
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        stays = F.lit(False)
        for pattern in literal_brackets:
            stays = stays | inner.rlike(pattern)
        return F.when(bracket & ~stays, F.lit(" ")).otherwise(piece)

    flat = F.array_join(F.transform(pieces, keep), "")
    return F.filter(F.transform(F.split(flat, r"\.{2,}"), collapse), lambda p: p != "")


def significant_words(text: Column) -> Column:
    """Distinct words of more than two ASCII letters or digits that aren't stop words."""
    words = F.regexp_extract_all(normalize_whitespace(text), F.lit(r"(?U)\b([a-z0-9]+)\b"), F.lit(1))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*[F.lit(w) for w in STOPWORDS]))


def overlap_of_words(query: Column, target: Column) -> Column:
    """Share in percent of the query's words that the target has; 0 without any."""
    return F.when(F.size(query) > 0, 100.0 * F.size(F.array_intersect(query, target)) / F.size(query)).otherwise(0.0)


def word_overlap(query: Column, target: Column) -> Column:
    return overlap_of_words(significant_words(query), significant_words(target))


def split_sentences(text: Column, min_length: int = 20) -> Column:
    """Sentences of at least min_length characters; their final mark is dropped where another follows."""
    flat = F.regexp_replace(text, SPACE + "+", " ")
    # Not F.trim itself: of its two parameters, transform() would fill the second with the place.
    return F.filter(F.transform(F.split(flat, "[.!?] "), lambda s: F.trim(s)), lambda s: F.length(s) >= min_length)


def split_fragments(text: Column) -> Column:
    """Parts between sentence marks that white space follows, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"[.!?]" + SPACE + "+"), lambda p: F.regexp_replace(p, f"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(parts, lambda p: p != "")


def character_mapping(text: Column, mappings: Mapping[str, str] = CHARACTER_MAPPINGS) -> Column:
    """Replacements one after another, each over the result of those before it."""
    for old, new in mappings.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def contains_all(content_norm: Column, parts: Column) -> Column:
    """Whether normalised content contains every part, normalised, in any order."""
    return F.forall(parts, lambda p: F.contains(content_norm, normalize_text(p)))


def first_missing(content_norm: Column, parts: Column) -> Column:
    """The first part that normalised content lacks; null if it has them all."""
    return F.get(F.filter(parts, lambda p: ~F.contains(content_norm, normalize_text(p))), F.lit(0))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.95, "HIGH").when(score >= 0.80, "MEDIUM").when(score >= 0.50, "LOW").otherwise("VERY_LOW")


def can_auto_fix(action_type: Column, confidence_: Column, repaired: Column) -> Column:
    return ~action_type.isin("REMOVAL", "UNVERIFIABLE") & (confidence_ == "HIGH") & repaired.isNotNull()


def severity(level: Column) -> Column:
    """WARN and WARNING are WARN, INFO stays, everything else is ERROR."""
    up = F.upper(level)
    return F.when(up.isin("WARN", "WARNING"), "WARN").when(up == "INFO", "INFO").otherwise("ERROR")


def yaml_scalar(value: str | None) -> str:
    """A string as a YAML scalar, in double quotes where plain style would read differently."""
    if value is None:
        return "null"
    plain = re.fullmatch(r"[A-Za-z_][\w ./()+-]*", value) and value == value.strip() and value.lower() not in ("null", "true", "false", "yes", "no", "on", "off")
    if plain:
        return value
    escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
    return f'"{escaped}"'
