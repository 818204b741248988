"""Secret scans with DataFrame functions only: three base patterns, and a battery of randomness tests.

The battery takes maximal runs of encoding characters, infers each run's encoding from the characters that it has
(hex, base32 or base64; each needs digits and letters, base64 both cases), and asks whether its symbols look drawn at
random: a chi-squared test of uniform use of the alphabet, a runs test about the alphabet's middle and a test of
serial correlation. Each is a test of equivalence: its null hypothesis is that the run departs from chance by at least
a margin (two thirds of what words joined by capitals do), so that a small p-value says "random"; a run's p-value is the largest of the three.
Within a document, p-values are weighted by length and judged by the Benjamini-Hochberg rule: of the runs reported as
kind ``random``, a share of LEVEL at most is expected to be none.

Work is linear in a text's length and, but for sorting, in the number of its spans. Every operator
here takes a null text as empty; an empty text has no spans; texts of any length are read whole. Rows that repeat, or
that have a null doc_id, are rows of their own. Spans that start together are in the order of KINDS. A table without
rows gives one. Columns that an operator does not read may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinql.llm.shared import fresh

#: Fixed patterns of the base kinds, and the least length of what they must hold.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: Runs shorter than this are too short for the tests to tell language from chance.
RANDOM_LEAST = 20
RANDOM = rf"[A-Za-z0-9+/_-]{{{RANDOM_LEAST},}}"
#: Expected share of runs that are not random among those reported.
LEVEL = 0.05
#: Margins of the null hypotheses: excess of the sum of squared shares over that of uniform use, as a multiple of the
#: latter, by bit of a symbol; turns about the middle, by symbol; correlation with the symbol before.
SHARES, TURNS, CORRELATION = 0.2, 0.35, 0.6
_HEX, _B32, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Elements of a chunk of a running total.
SCANNED = 128
#: Code points of the pieces that a text is cut into before spans are cut out of it.
_CHUNK = 1024
_SPANS = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"
_FAR = 1 << 60


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; lambdas compute what they capture anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(x: Column, join, zero: int = 0, levels: int = 2) -> Column:
    """Running totals of an array under ``join``: within chunks, on top of the running totals of the chunks."""
    start = F.lit(zero).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, start, lambda p, q: join(p, q))

    def within(a: Column, before: Column) -> Column:
        def at(i: Column) -> Column:
            inside = total(F.slice(a, F.floor(i / SCANNED).cast("int") * SCANNED + 1, i % SCANNED + 1))
            return join(F.coalesce(F.get(before, F.floor(i / SCANNED).cast("int") - 1), start), inside)

        return F.transform(a, lambda _, i: at(i))

    def scanned(a: Column) -> Column:
        if not levels:
            return F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i + 1)))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SCANNED).cast("int")), lambda c: total(F.slice(a, c * SCANNED + 1, F.lit(SCANNED))))
        return _let(_scan(chunks, join, zero, levels - 1), lambda before: within(a, before))

    return _let(x, lambda a: F.when(F.size(a) > 0, scanned(a)).otherwise(a))


def _none() -> Column:
    return F.array().cast(_SPANS)


def _matches(text: str, pattern: str, kind: int) -> Column:
    """Structs (start, kind, end, text) of the leftmost matches, in order: code points, end exclusive."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.char_length(m))
        return F.zip_with(_scan(steps, lambda a, b: a + b), found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("text")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(_none()))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, to about 1e-4."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z))))


def _p_value(token: Column) -> Column:
    """p-value of "this run departs from chance"; null where no encoding is inferred."""
    digit, lower, upper = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    hexed = digit & ((lower & ~upper) | (upper & ~lower)) & token.rlike("^[0-9A-Fa-f]+$")
    b32, b64 = digit & upper & token.rlike("^[A-Z2-7]+$"), digit & upper & lower
    plain = F.translate(token, "-_", "+/")

    def coded(letters: str, text: Column) -> Column:
        half = len(letters) // 2
        sides = F.translate(text, letters, "L" * half + "H" * half)
        return F.struct(F.lit(letters).alias("s"), text.alias("t"), sides.alias("sides"))

    def counted(c: Column) -> Column:
        n, k = F.char_length(c["t"]), F.char_length(c["s"])
        squares = F.aggregate(F.transform(F.sequence(F.lit(1), k), lambda j: n - F.char_length(F.replace(c["t"], F.substring(c["s"], j, F.lit(1))))), F.lit(0.0), lambda a, m: a + m.cast("double") * m)
        values = F.transform(F.filter(F.split(c["t"], ""), lambda x: x != ""), lambda x: F.instr(c["s"], x).cast("double"))
        return F.struct(
            n.cast("double").alias("n"), k.cast("double").alias("k"), squares.alias("squares"), F.regexp_count(c["sides"], F.lit("H")).cast("double").alias("high"),
            (1 + F.regexp_count(c["sides"], F.lit("L(?=H)|H(?=L)"))).cast("double").alias("turns"), values.alias("v"),
        )

    def centred(c: Column) -> Column:
        mid = F.aggregate(c["v"], F.lit(0.0), lambda a, x: a + x) / c["n"]
        return _let(mid, lambda m: F.struct(c.alias("c"), F.transform(c["v"], lambda x: x - m).alias("d")))

    def judged(e: Column) -> Column:
        c, d = e["c"], e["d"]
        n, k = c["n"], c["k"]
        df, off = k - 1, n * SHARES * F.log2(k)
        p1 = 1 - _upper_tail((k * c["squares"] / n - n - df - off) / F.sqrt(2 * (df + 2 * off)))
        away = F.abs(c["turns"] - 1 - 2 * c["high"] * (n - c["high"]) / n)
        p2 = F.when((c["high"] > 0) & (c["high"] < n), _upper_tail((TURNS * n - away) / (0.5 * F.sqrt(n)))).otherwise(F.lit(1.0))
        variance = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)
        products = F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), lambda x, y: x * y)
        own = F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / F.greatest(variance, F.lit(1e-9)) + 1 / n
        p3 = F.when(variance > 0, _upper_tail((CORRELATION - F.abs(own)) * F.sqrt(n))).otherwise(F.lit(1.0))
        return F.greatest(p1, p2, p3)

    code = F.when(hexed, coded(_HEX, F.lower(token))).when(b32, coded(_B32, token)).when(b64, coded(_B64, plain))
    return _let(code, lambda c: F.when(c.isNotNull(), _let(counted(c), lambda x: _let(centred(x), judged))))


def _free(runs: Column, base: Column) -> Column:
    """The runs that share no character with a base span: one sorted line of both, with the ends before and the starts behind."""
    far = F.lit(_FAR).cast("long")
    line = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("is_run"), b["end"].alias("end"), F.lit("").alias("text"))), F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("is_run"), r["end"].alias("end"), r["text"].alias("text")))))

    def apart(x: Column) -> Column:
        ends = _scan(F.transform(x, lambda s: F.when(s["is_run"] == 0, s["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest, -1)
        starts = F.reverse(_scan(F.reverse(F.transform(x, lambda s: F.when(s["is_run"] == 0, s["start"]).otherwise(far))), F.least, _FAR))
        limits = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        kept = F.zip_with(x, limits, lambda s, m: F.when((s["is_run"] == 1) & (m["e"] <= s["start"]) & (m["s"] >= s["end"]), s))
        return F.filter(kept, lambda s: s.isNotNull())

    return _let(line, apart)


def _random_spans(runs: Column, base: Column) -> Column:
    """Of the runs clear of base spans and with an encoding, those that the weighted Benjamini-Hochberg rule rejects as not random."""

    def tested(free: Column) -> Column:
        tried = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _p_value(r["text"]).alias("p")))
        return _let(F.filter(tried, lambda r: r["p"].isNotNull()), lambda t: F.when(F.size(t) > 0, weighed(t)).otherwise(_none()))

    def weighed(t: Column) -> Column:
        mean = F.aggregate(t, F.lit(0.0), lambda a, r: a + (r["end"] - r["start"])) / F.size(t)
        return _let(mean, lambda m: _let(F.transform(t, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), (r["p"] * m / (r["end"] - r["start"])).alias("p"))), chosen))

    def chosen(t: Column) -> Column:
        limits = F.zip_with(F.sort_array(F.transform(t, lambda r: r["p"])), F.sequence(F.lit(1), F.size(t)), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        worst = _let(F.size(t), lambda n: F.array_max(F.transform(limits, lambda x: F.when(x["p"] <= LEVEL * x["i"] / n, x["p"]).otherwise(F.lit(-1.0)))))
        return _let(worst, lambda w: F.transform(F.filter(t, lambda r: r["p"] <= w), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end"), F.lit("").alias("text"))))

    return _let(F.when(F.size(base) > 0, _free(runs, base)).otherwise(F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("is_run"), r["end"].alias("end"), r["text"].alias("text")))), tested)


def with_spans(docs: DataFrame, text: str = "text", base: str = "base_spans", random: str = "random_spans") -> DataFrame:
    """``docs`` with two arrays of structs (start, kind, end, text), each by start, then kind; their names must be free."""
    own, assign, access, hexed, run = fresh(docs, "text", "assign", "access", "hex", "run")
    df = docs.withColumn(own, F.coalesce(F.col(text).cast("string"), F.lit("")))
    long_enough = F.filter(_matches(own, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LEAST)
    df = df.withColumn(assign, long_enough)
    df = df.withColumn(access, _matches(own, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", 1))  # the same matches as ACCESS that are long enough: a run that fails holds no longer one
    df = df.withColumn(hexed, _matches(own, f"[0-9a-f]{{{HEX_LEAST},}}", 2))
    df = df.withColumn(run, _matches(own, RANDOM, 3))
    df = df.withColumn(base, F.sort_array(F.concat(assign, access, hexed)))
    df = df.withColumn(random, F.when(F.size(run) > 0, _let(F.col(base), lambda b: _let(F.col(run), lambda r: _random_spans(r, b)))).otherwise(_none()))
    return df.drop(own, assign, access, hexed, run)


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row of ``docs``."""
    df = with_spans(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return df.select(
        "doc_id", *map(count, range(3)), F.size("random_spans").cast("long").alias("n_random"), F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base_spans", "random_spans"))).alias("spans"),
    )


def _between(spans: Column, length: Column) -> Column:
    """Structs (a, b): the stretches of a text that no span covers, one before, between and after the joined spans."""

    def joined(s: Column) -> Column:
        reach = _scan(F.transform(s, lambda x: x["end"]), F.greatest)
        return _let(reach, lambda e: borders(s, e))

    def borders(s: Column, e: Column) -> Column:
        """A span that starts beyond all ends before it opens a new joined span, which ends the one before."""
        opens = F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] > F.get(e, i - 1)), F.struct(F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0).cast("long")).alias("a"), x["start"].alias("b"))))
        tail = F.array(F.struct(F.element_at(e, -1).alias("a"), length.cast("long").alias("b")))
        return F.concat(F.filter(opens, lambda x: x.isNotNull()), tail)

    return _let(spans, joined)


def _cut(text: Column, stretches: Column, mark: str) -> Column:
    """The stretches of ``text``, joined by ``mark``; each is put together from the pieces that it lies in."""

    def stretch(s: Column, pieces: Column) -> Column:
        def part(c: Column) -> Column:
            low = F.greatest(s["a"] - c * _CHUNK, F.lit(0).cast("long"))
            high = F.least(s["b"] - c * _CHUNK, F.lit(_CHUNK).cast("long"))
            return F.substring(F.get(pieces, c.cast("int")), (low + 1).cast("int"), (high - low).cast("int"))

        inside = F.transform(F.sequence(F.floor(s["a"] / _CHUNK), F.floor((s["b"] - 1) / _CHUNK)), part)
        return F.when(s["b"] > s["a"], F.array_join(inside, "")).otherwise(F.lit(""))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return _let(pieces, lambda p: F.array_join(F.transform(stretches, lambda s: stretch(s, p)), mark))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; spans that overlap or touch become one.

    n_chars follows if there is one; texts without a span, null ones too, stay as they are.
    """
    base, random, spans = fresh(docs, "base", "random", "spans")
    df = with_spans(docs, "text", base, random).withColumn(spans, F.sort_array(F.concat(base, random)))
    some = F.size(spans) > 0
    text = _let(_between(F.col(spans), F.char_length("text")), lambda s: _cut(F.col("text"), s, mark))
    df = df.withColumn("text", F.when(some, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(some, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)
