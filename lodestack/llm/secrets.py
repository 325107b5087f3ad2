"""Secret scan: pattern matches, and windows of high Shannon entropy over candidate strings.

Only DataFrame functions are used, and all of them work within a row: there is no shuffle, so neither a hot source nor
repeated rows matter. Time grows in proportion to a text's length, whatever its runs, candidates and spans: arrays are bound once
and folded in slices, no pattern nests quantifiers, and texts are cut by pieces of fixed length.
A null text counts as empty and gives no spans; extra columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, running

# The patterns of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy method (a whole run of the alphabet), the window in characters, and the least entropy in bits
#: by character class.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "alnum": 3.55, "base64": 3.7}
#: Strings that look random but are no secrets: placeholders, checksummed package references, UUIDs, runs.
ALLOWED = (
    r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh|qwerty)"
    r"|^(?:sha1|sha256|sha384|sha512|md5)-|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|(.)\1{7}"
)
#: Longer candidates are no placeholders, whatever they hold.
ALLOWED_LENGTH = 128
#: A part of a path that is allowed: letters, or few digits after them.
PATH_PART = r"^[A-Za-z_=-]{0,40}[0-9]{0,4}$"
#: Code points of the pieces that texts are cut into.
PIECE = 4096
#: Window counts are packed twelve to a long, five bits each; the alphabet's codes run from + to z.
_PER_LONG, _FIRST, _LONGS = 12, ord("+"), 7


def _before(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of ints."""
    return running(lengths, F.lit(0), lambda at, x: (at + x, at), "int")


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start int, stop int, found string>>, in code points.

    The text between the matches comes from ``split``, which walks the same matches; with the matches' own lengths it gives
    every position.
    """

    def placed(found: Column, gaps: Column) -> Column:
        # a gap and the match after it; the last gap has no match
        steps = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)),
            found,
            lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), m.alias("found")),
        )
        return running(
            steps,
            F.lit(0),
            lambda at, s: (
                at + s["gap"] + s["long"],
                F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["long"]).alias("stop"), s["found"].alias("found")),
            ),
            "struct<start:int,stop:int,found:string>",
        )

    spans = bound(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: bound(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,stop:int,found:string>>"))


def peak_entropy(found: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of ``window`` (at most 31) characters in ``found``, a string
    of the candidates' alphabet.

    One step to the right changes the counts of the character that enters and the one that leaves, and no other. The counts
    are carried along in the fields of a few longs, and so is the sum of c log2 c over them.
    """
    terms = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    names = [f"l{k}" for k in range(_LONGS)]
    shift = lambda c: (F.pmod(c, F.lit(_PER_LONG)) * 5).cast("int")
    code = lambda c: F.ascii(c) - _FIRST

    def cell(c: Column) -> Column:
        """Which long a character is counted in, where in it, and a one at that place."""
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(c))
        return F.struct(F.floor(c / _PER_LONG).cast("int").alias("k"), shift(c).alias("at"), one.alias("one"))

    def count(state: Column, x: Column) -> Column:
        word = F.get(F.array(*[state[n] for n in names]), x["k"])
        return F.call_function("shiftright", word, x["at"]).bitwiseAND(F.lit(31)).cast("int")

    def changed(state: Column, x: Column, sign: int, total: Column, least: Column) -> Column:
        one = x["one"] if sign > 0 else -x["one"]
        longs = [F.when(x["k"] == i, state[n] + one).otherwise(state[n]).alias(n) for i, n in enumerate(names)]
        return F.struct(*longs, total.alias("total"), least.alias("least"))

    def walk(cells: Column) -> Column:
        n = F.size(cells)
        full = F.least(n, F.lit(window))

        def enter(state: Column, x: Column) -> Column:
            total = state["total"] + bound(count(state, x["into"]), lambda c: F.get(terms, c + 1) - F.get(terms, c))
            return bound(
                total,
                lambda t: changed(
                    state, x["into"], 1, t, F.when(x["nth"] + 1 >= full, F.least(state["least"], t)).otherwise(state["least"])
                ),
            )

        def leave(state: Column, x: Column) -> Column:
            total = state["total"] + bound(count(state, x["gone"]), lambda c: F.get(terms, c - 1) - F.get(terms, c))
            return changed(state, x["gone"], -1, total, state["least"])

        steps = F.transform(
            cells,
            lambda x, i: F.struct(i.alias("nth"), x.alias("into"), F.get(cells, i - window).alias("gone")),
        )
        zero = F.struct(
            *[F.lit(0).cast("bigint").alias(x) for x in names], F.lit(0.0).alias("total"), F.lit(1e9).alias("least")
        )
        least = F.aggregate(
            steps, zero, lambda s, x: bound(F.when(x["gone"].isNull(), s).otherwise(leave(s, x)), lambda r: enter(r, x))
        )["least"]
        return F.when(n > 0, F.log2(full.cast("double")) - least / full).otherwise(F.lit(0.0))

    return bound(F.transform(F.filter(F.split(found, ""), lambda c: c != ""), lambda c: cell(code(c))), walk)


def reaches(found: Column, least: Column) -> Column:
    """Whether a window of ``found`` has an entropy of ``least`` or more. Long strings are walked in pieces, each with the end of the
    one before it, so that memory stays bounded, and no further than to the first piece that does."""

    def walk(pieces: Column) -> Column:
        before = lambda k: F.when(k > 0, F.right(F.get(pieces, k - 1), F.lit(WINDOW - 1))).otherwise(F.lit(""))
        return F.exists(
            F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: peak_entropy(F.concat(before(k), F.get(pieces, k))) >= least
        )

    return bound(F.regexp_extract_all(found, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), walk)


def _is_secret(found: Column) -> Column:
    """A candidate that holds letters and digits, passes its class's entropy and isn't on the allow-list."""
    mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    least = (
        F.when(found.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"])
        .when(found.rlike("^[0-9A-Za-z]+$"), LEAST_BITS["alnum"])
        .otherwise(LEAST_BITS["base64"])
    )
    path = found.contains("/") & F.forall(F.split(found, "/"), lambda p: p.rlike(PATH_PART))
    # the cheap gates first: most candidates are long words without a digit
    allowed = (F.length(found) <= ALLOWED_LENGTH) & found.rlike(ALLOWED)
    return F.when(~mixed | allowed | path, F.lit(False)).otherwise(reaches(found, least))


def _spans(text: str) -> Column:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def kind(i: int, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(i).alias("rank"), s["stop"].alias("stop"), F.lit(KINDS[i]).alias("kind")
            ),
        )

    value = lambda s: F.regexp_extract(s["found"], ASSIGN, 2)
    spans = F.array_sort(
        F.concat(
            kind(0, F.filter(matches(whole, ASSIGN), lambda s: F.length(value(s)) >= 8)),
            kind(1, matches(whole, r"AKIA[A-Z0-9]{12,}")),
            kind(2, matches(whole, r"(?<![0-9a-f])[0-9a-f]{32,}")),
            kind(3, F.filter(matches(whole, CANDIDATE), lambda s: _is_secret(s["found"]))),
        )
    )
    spans = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    )
    return spans


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secret_spans``: array<struct<start int, stop int, kind string>>, sorted by start and then kind as listed.

    Kinds: ``assign`` (a named credential with a value of 8 or more characters), ``access`` (AKIA and 16 or more
    characters), ``hex`` (32 or more), and ``entropy`` (the window method). Starts and ends are code points, the end
    exclusive. Spans of different kinds may overlap. A column of that name is replaced.
    """
    return docs.withColumn("secret_spans", _spans(text))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span that ``scan`` finds by ``mark``; overlapping and touching spans become one mark.

    Texts without a span, nulls included, stay as they are, and the columns stay the same.
    """
    body = F.col(f"`{text}`")

    def cut(chunks: Column, start: Column, stop: Column) -> Column:
        """Code points from ``start`` to ``stop``: of the first and last piece a part, those between them whole."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
        head = F.substring(F.get(chunks, first), F.pmod(start, F.lit(PIECE)) + 1, stop - start)
        tail = F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), F.pmod(stop, F.lit(PIECE)))
        middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(stop <= start, F.lit("")).when(first == last, head).otherwise(F.concat(head, middle, tail))

    # what is kept before each span; none where the span touches the ones before it
    kept = lambda spans: running(
        spans,
        F.lit(-1),
        lambda at, x: (
            F.greatest(at, x["stop"]),
            F.struct(
                F.greatest(at, F.lit(0)).alias("start"), x["start"].alias("stop"), ((x["start"] > at) | (at < 0)).alias("gap")
            ),
        ),
        "struct<start:int,stop:int,gap:boolean>",
    )
    clean = lambda spans, chunks: F.concat(
        F.array_join(
            F.transform(F.filter(kept(spans), lambda x: x["gap"]), lambda x: F.concat(cut(chunks, x["start"], x["stop"]), F.lit(mark))), ""
        ),
        cut(chunks, F.array_max(F.transform(spans, lambda x: x["stop"])), F.length(body)),
    )
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = bound(
        _spans(text),
        lambda spans: F.when(F.size(spans) > 0, bound(pieces, lambda chunks: clean(spans, chunks))).otherwise(body),
    )
    return docs.withColumn(text, done)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``. One row a row of the table; no rows for an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans, base = F.col("secret_spans"), F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
        count("entropy"),
    )
