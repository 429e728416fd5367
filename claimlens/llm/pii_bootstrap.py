"""Operator 2. PII by bootstrapped contextual extraction.

Base patterns find e-mails, IP addresses, payment cards and phone numbers: these are the seeds,
worth 1, and what a base pattern has rejected (a card that fails Luhn) is worth 0. Any other
token that may be an identifier has evidence of its own, which grows with the changes between
letters and digits in it: next to none for numbers, dates and names, nearly 1 for keys and
hashes. The words around such tokens are their lexical patterns. A graph of patterns and
instances is scored in rounds (after DIPRE and Snowball): a pattern is worth the mean of its
instances, times the share of its words' occurrences in the corpus that stand beside such
tokens, so that words which surround ordinary text, too, teach nothing; an instance is worth
its best pattern, or its own evidence if that is more. Patterns of high confidence then mark
all tokens that they surround, whatever these look like.

A token is what stands between white space, without the punctuation at its ends and without
a leading name and = or :, if it holds a digit or @ and has MIN_TOKEN characters or more.
Identifiers of several words, or of letters alone, are not discovered. Strings that can only be
secrets are reported apart where no pattern has discovered them; they teach nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.shared import cut, fits_broadcast, numbered, pick

KINDS = ("email", "ip", "card", "phone", "secret", "other")
SECRET, OTHER = KINDS.index("secret"), KINDS.index("other")
ROUNDS = 3
#: A pattern needs so many different instances, and this confidence, to discover others.
MIN_SUPPORT = 5
CONFIDENCE = 0.8
#: Added to a pattern's number of instances, so that few of them prove little.
DOUBT = 1.0
MIN_TOKEN = 5
#: Longer words are no context: they don't recur.
MAX_WORD = 40
#: Changes between letters and digits that may occur in any name; each one more halves the doubt.
COMMON_CHANGES = 2
#: A secret that is reported apart: one run of so many ASCII letters and digits, with so many of each.
SECRET_LENGTH, SECRET_MIX = 20, 4
#: Trusted patterns that one pass over the rows holds; more patterns, more passes.
PATTERN_BLOCK = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{%d,}+" % SECRET_LENGTH)
_EDGE = ".,;:!?\"'`()[]{}<>|"
_QUOTES = "\"'`"
_SIGNS = _EDGE + "=#"
_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: long runs cost no more."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, four by four."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, numbers = m.start(), m.group().split(".")
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base matches, in that order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(a, 1, b) for a, b in _ips(text)]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def secret_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of strings that can only be secrets, outside base spans."""
    found, k, covered = [], 0, sorted((a, b) for a, _, b in base)
    for m in _RUN.finditer(text):
        digits = len(_digits(m.group()))
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if min(digits, len(m.group()) - digits) >= SECRET_MIX and not (k < len(covered) and covered[k][0] < m.end()):
            found.append((m.start(), SECRET, m.end()))
    return found


def own_evidence(value: str) -> float:
    """How far a token looks like a key by itself."""
    return 1 - 2.0 ** -max(0, len(_CHANGE.findall(value)) - COMMON_CHANGES)


def rejected_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of what looks like a card but fails Luhn, and isn't part of a longer token."""
    whole = lambda a, b: not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
    return [m.span() for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and not _luhn(d) and whole(*m.span())]


def _word(text: str, at: int, step: int) -> tuple[str, int]:
    """The next word from `at` on in either direction, and where the search stopped; '' at a
    line's end. Punctuation that stands by itself, as = and quotes, is passed over."""
    n = len(text)
    while 0 <= at < n and text[at] not in "\r\n":
        if text[at].isspace():
            at += step
            continue
        start = at
        while 0 <= at < n and not text[at].isspace() and abs(at - start) <= MAX_WORD:
            at += step
        word = (text[start:at] if step > 0 else text[at + 1 : start + 1]).strip(_SIGNS).lower()
        if word:
            return (word if len(word) <= MAX_WORD else ""), at
    return "", at


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, the two before, the one after, both
    sides; of words with letters and without digits."""
    one, at = _word(text, start - 1, -1)
    two, _ = _word(text, at, -1) if one else ("", at)
    after, _ = _word(text, end, 1)
    made = [f"L {one}" if one else "", f"LL {two} {one}" if one and two else "", f"R {after}" if after else "", f"LR {one} {after}" if one and after else ""]
    return [p for p in made if p and not any(c.isdigit() or c == "@" for c in p) and all(any(map(str.isalpha, w)) for w in p.split(" ")[1:])]


def tokens(text: str, seeds: list[tuple[int, int, int]], rejected: list[tuple[int, int]]) -> Iterator[tuple[int, int, float | None]]:
    """(start, end, worth) of seeds (1), of rejected spans (0), and of the other identifier-like tokens (None)."""
    for a, _, b in seeds:
        yield a, b, 1.0
    taken = sorted((a, b) for a, _, b in seeds)
    k = 0
    for a, b in rejected:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] < b):
            yield a, b, 0.0
    covered, k, done = sorted([*taken, *rejected]), 0, 0
    for m in _MARK.finditer(text):
        a, b = m.start(), m.end()
        while a > done and not text[a - 1].isspace():
            a -= 1
        done = b
        # A leading name and = or : is context, not part of the token.
        head = max(text.rfind("=", a, m.start()), text.rfind(":", a, m.start()))
        if head >= 0:
            a = head + 1
        while a < b and text[a] in _EDGE:
            a += 1
        if a and text[a - 1] in _QUOTES:  # a quoted token ends with its quote
            b = text.find(text[a - 1], a, b) % (b + 1)
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if b - a >= MIN_TOKEN and not (k < len(covered) and covered[k][0] < b):
            yield a, b, None


def marks_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, float | None, list[str]]]]:
    """Base spans, secrets, and (start, end, worth, patterns) of each token that has patterns."""
    base = base_spans(text)
    secrets = secret_spans(text, base)
    found = [(a, b, worth, contexts(text, a, b)) for a, b, worth in tokens(text, base, rejected_spans(text))]
    return base, secrets, [m for m in found if m[3]]


_SPANS = "array<struct<start:long,kind:int,end:long>>"
_FOUND = f"doc_id long, base {_SPANS}, secrets {_SPANS}, marks array<struct<start:long,end:long,instance:long,worth:double,own:double,patterns:array<string>>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_MARKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("worth", pa.float64()), ("own", pa.float64()), ("patterns", pa.list_(pa.string()))]))


def _spans(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": a, "kind": k, "end": b} for a, k, b in found]


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"base": [], "secrets": [], "marks": []}
            for text in batch.column(1).to_pylist():
                text = text or ""
                base, secrets, marks = marks_of(text)
                value = lambda a, b: int.from_bytes(hashlib.blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)  # noqa: B023, E731
                out["base"].append(_spans(base))
                out["secrets"].append(_spans(secrets))
                out["marks"].append([{"start": a, "end": b, "instance": value(a, b), "worth": worth, "own": own_evidence(text[a:b]), "patterns": p} for a, b, worth, p in marks])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "base": pa.array(out["base"], _SPAN), "secrets": pa.array(out["secrets"], _SPAN), "marks": pa.array(out["marks"], _MARKS)})

    return docs.mapInArrow(run, _FOUND)


def word_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): how often the `text`s of the corpus hold each of these words (word), without
    punctuation at its ends and in lower case. Counts are partial before the shuffle."""
    said = texts.select(F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("word")).select(F.btrim("word", F.lit(_SIGNS)).alias("word"))
    return said.join(fits_broadcast(words), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def pattern_scores(marks: DataFrame, texts: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(pattern, confidence) from marks of (pattern, instance, worth: 1, 0 or null, own) and the
    corpus (text). Each pair counts once, so that copies of a text prove nothing more. Both joins
    are equi-joins whose frequent keys the planner splits; sums are partial before each shuffle.

    A pattern's words occur beside marked tokens as often as the pattern does, and elsewhere in
    the rest of the occurrences of the rarest of them: of two words together, that is less than
    their true share."""
    edges = cut(marks.groupBy("pattern", "instance").agg(F.max("worth").alias("fixed"), F.max("own").alias("own"), F.count("*").alias("times")))
    wide = cut(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where(F.col("n") >= min_support))
    parts = cut(wide.select("pattern", "times", F.explode(F.slice(F.split("pattern", " "), 2, 2)).alias("word")))
    counts = cut(word_counts(texts, cut(parts.select("word").distinct())))
    shares = parts.join(counts, "word", "left").groupBy("pattern").agg(F.least(F.lit(1.0), F.max("times") / F.min(F.coalesce("n", "times"))).alias("share"))
    edges = cut(edges.join(wide.join(shares, "pattern").select("pattern", "n", "share"), "pattern").select("pattern", "instance", "fixed", "own", "n", "share"))
    # A value that is a seed somewhere is one everywhere; so is a rejected one, if it's no seed.
    known = cut(edges.groupBy("instance").agg(F.max("fixed").alias("fixed"), F.max("own").alias("own")))
    worth = known.select("instance", F.coalesce("fixed", "own").alias("worth"))
    for k in range(rounds):
        scored = cut(edges.join(worth, "instance").groupBy("pattern").agg((F.sum("worth") / (F.max("n") + DOUBT) * F.max("share")).alias("confidence")))
        if k + 1 < rounds:
            best = edges.join(scored, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
            worth = cut(known.join(best, "instance").select("instance", F.coalesce("fixed", F.greatest("own", "best")).alias("worth")))
    return scored


def _trusted(found: DataFrame, texts: DataFrame, rounds: int, min_support: int, confidence: float, block: int) -> Iterator[frozenset]:
    """The patterns that discover, in blocks of bounded size; the driver holds one at a time."""
    marks = found.select(F.explode("marks").alias("m")).select("m.instance", "m.worth", "m.own", F.explode("m.patterns").alias("pattern"))
    held: list[str] = []
    for row in cut(pattern_scores(marks, texts, rounds, min_support).where(F.col("confidence") >= confidence)).toLocalIterator():
        held.append(row["pattern"])
        if len(held) == block:
            yield frozenset(held)
            held = []
    if held:
        yield frozenset(held)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, confidence: float = CONFIDENCE, block: int = PATTERN_BLOCK) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (all, as kind:start:end by start), n_secret (not discovered), n_other
    (discovered), n_spans (all), items (array of start, kind, end).

    Offsets count code points of the whole text, however long, ends are exclusive. Null and
    empty texts have no spans. Null and repeated ids are rows like others, each judged by its
    own text. An empty table gives an empty result; further columns are ignored, whatever
    they are called."""
    docs = pick(docs, "doc_id", "text")
    found = cut(_scan(docs))
    rows = found.withColumn("new", F.array().cast(_SPANS))
    for patterns in _trusted(found, docs, rounds, min_support, confidence, block):
        held = docs.sparkSession.sparkContext.broadcast(patterns)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = []
                for seen, marks in zip(batch.column("new").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                    new.append(seen + [{"start": m["start"], "kind": OTHER, "end": m["end"]} for m in marks if m["worth"] is None and not held.value.isdisjoint(m["patterns"])])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, _SPAN)], names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    rows = rows.withColumn("new", F.array_distinct("new"))
    apart = F.filter("secrets", lambda s: ~F.exists("new", lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    rows = rows.withColumn("secrets", apart).withColumn("items", F.sort_array(F.concat("base", "secrets", "new")))
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("items")).alias("spans"), F.size("secrets").cast("long").alias("n_secret"), F.size("new").cast("long").alias("n_other"), F.size("items").cast("long").alias("n_spans"), "items")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with its spans (start, kind, end) replaced by their kinds in brackets, spans that
    overlap as one, by the kind of the first."""
    parts, at = [], 0
    for a, k, b in sorted(found):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, confidence: float = CONFIDENCE, block: int = PATTERN_BLOCK) -> DataFrame:
    """docs, all columns and rows, with what pii_spans() finds in `text` replaced by its kind.

    Each row's text is masked where it stands, in the pass that finds its spans: no row is
    looked up again, so that null and repeated ids are masked like others. Null texts stay."""
    plain, at = numbered(docs)
    texts = plain.select(F.lit(None).cast("long").alias("doc_id"), F.col(at("text")).alias("text"))
    found = cut(_scan(texts).where(F.size("marks") > 0))
    k = docs.columns.index("text")
    rows = plain.withColumn("_new", F.array().cast(_SPANS))
    blocks = list(_broadcast(docs, _trusted(found, texts, rounds, min_support, confidence, block))) or [None]
    for n, held in enumerate(blocks):

        def run(batches: Iterator[pa.RecordBatch], held=held, last=n + 1 == len(blocks)) -> Iterator[pa.RecordBatch]:
            trusted = held.value if held else frozenset()
            for batch in batches:
                texts, new = [], []
                for text, seen in zip(batch.column(k).to_pylist(), batch.column("_new").to_pylist(), strict=True):
                    base, secrets, marks = marks_of(text or "")
                    seen = seen + _spans([(a, OTHER, b) for a, b, worth, patterns in marks if worth is None and not trusted.isdisjoint(patterns)])
                    new.append(seen)
                    if last and text is not None:
                        discovered = [(s["start"], s["kind"], s["end"]) for s in seen]
                        secrets = [s for s in secrets if not any(a < s[2] and s[0] < b for a, _, b in discovered)]
                        text = masked(text, [*base, *secrets, *discovered])
                    texts.append(text)
                columns = [*batch.columns[:-1], pa.array(new, _SPAN)]
                columns[k] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.drop("_new").toDF(*docs.columns)


def _broadcast(docs: DataFrame, blocks: Iterator[frozenset]) -> Iterator:
    for block in blocks:
        yield docs.sparkSession.sparkContext.broadcast(block)
