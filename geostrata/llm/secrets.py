"""Secret scans: rules for well-known forms, and Markov models for random strings.

All of it is DataFrame expressions. The rules' matches get their positions from the lengths of the
matches and of the gaps between them. Beyond the rules, every long token of credential characters is
scored by the log-likelihood ratio of two character Markov chains, one of random strings and one of
ordinary identifiers, fitted on labelled samples:

* random: generated strings in the forms that keys take (hexadecimal, base 64, 62, 36 and 32), and
  values that the rules found in a bounded sample of texts;
* ordinary: generated identifiers in the styles that code and paths use, made of everyday words, and
  the other tokens of those texts, so that the corpus' own languages are known.

The fitted ratio is a table of 68 x 68 numbers, whatever the input, and is part of the expression. It
alone decides, whatever characters a token has. Time grows in proportion to a text's length, however
many matches it has: running sums and maxima go by blocks of BLOCK.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import hash_share, read_table

#: The rules, in the order of their kinds (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # and the start
#: Tokens that the chains judge, and those that they learn from.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE_TOKEN = r"[A-Za-z0-9+/_=-]{6,}"
#: Rows sampled for fitting, in expectation, and generated strings of each form and style.
SAMPLE_ROWS = 5_000
GENERATED = 2_000
#: Elements of an array that are folded in one go, and code points of a text that are cut in one go.
BLOCK = 256
CHUNK = 1024
#: Words that generated identifiers are made of (fixed values).
IDENTIFIER_WORDS = """
    account action active address admin amount array async backup balance batch block board body buffer build button
    cache callback category center change channel check child class client code color column command config connection
    content control count current customer data database date default delete device directory document domain download
    edit element email empty enable encoder entry error event example export factory field file filter first flag folder
    height history home host identifier image import index info input internal item job join json kernel key keyword
    label language last layout length level library limit link list loader local lock log main manager map mask member
    memory message method mode model module name network node number object offset open option order output package page
    parser path payload pixel player plugin point policy price process profile project query queue quick range reader
    record region report request result role route sample schema script search server service session size source stack
    state status stream string summary system table target task template test thread time token transform tree type unit
    update upload user utility validate value vector version view volume wait web weight window wizard worker wrapper
    write xml yaml year yield zip zone zoom
""".split()
#: Ratio, in nats, from which a token counts as random. Held out, with chains fitted on 10,000 texts: of random strings of 16 characters 0.7% are missed, of 20 0.03%; of identifiers of unseen words 1.8% are taken.
LEAST_RATIO = 12.0
#: Of a character's ordinary transitions, the share that is added as runs: rules of dashes and the like.
RUNS = 0.05
#: Likewise, the share of a small letter's that is added as steps to a capital, whose letters count as independent of each other.
HUMPS = 0.05

SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_all(values: list[Column], body) -> Column:
    """body(*values), with each computed once."""
    return let(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]), lambda s: body(*[s[f"v{k}"] for k in range(len(values))]))


def running(values: Column, zero: Column, step, kind: str = "int") -> Column:
    """For each element of an array, the fold by ``step`` of those before it; step must be associative.

    Folded within blocks of BLOCK and then over the blocks, as an array that grows is copied at each step.
    """

    def folds(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("seen"))
        return F.aggregate(block, begin, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")))["seen"]

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda at: F.slice(v, at + 1, F.lit(BLOCK)))
        return let(blocks, lambda b: let(F.transform(b, lambda x: F.aggregate(x, zero, lambda s, y: step(s, y))), lambda sums: F.flatten(F.zip_with(b, folds(sums, zero), folds))))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, folds(v, zero)).otherwise(by_blocks(v)))


def match_spans(text: Column, pattern: str, kind: int, passes) -> Column:
    """Spans of the leftmost non-overlapping matches m with passes(m), in order.

    The pattern must not match the empty string. Where it matches nothing, it is run once only.
    """
    rule = F.lit(pattern)

    def located(matches: Column) -> Column:
        pieces = F.zip_with(
            F.split(text, pattern, -1), matches,
            lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("length"), F.coalesce(passes(m), F.lit(False)).alias("passes")),
        )

        def spans(p: Column) -> Column:
            before = running(F.transform(p, lambda x: x["gap"] + x["length"]), F.lit(0), lambda a, b: a + b)
            placed = F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["length"]).alias("end"), x["passes"].alias("passes")))
            return F.transform(F.filter(placed, lambda x: x["passes"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

        return let(pieces, spans)

    return let(F.regexp_extract_all(text, rule, F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    found = F.concat(
        match_spans(text, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        match_spans(text, ACCESS, 1, lambda m: F.char_length(m) >= 16),
        match_spans(text, HEX, 2, lambda m: F.char_length(m) >= 32),
    )
    return F.array_sort(found)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def states(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(tokens: DataFrame) -> DataFrame:
    """(random, step, n): how often each transition, from-state * STATES + to-state, is seen."""
    steps = tokens.select("random", states(F.col("token")).alias("to"))
    steps = steps.select("random", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.slice("to", 1, F.size("to") - 1)), F.col("to"), lambda a, b: a * STATES + b)).alias("step"))
    return steps.groupBy("random", "step").agg(F.count("*").alias("n"))


def random_strings(spark: SparkSession, n: int = GENERATED, seed: str = "sample") -> DataFrame:
    """(token): generated samples of the label "random", n of each form."""
    digest = F.sha2(F.concat_ws(" ", F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    text = F.base64(F.unhex(digest))
    forms = [digest, text, F.translate(text, "+/=", ""), F.translate(F.lower(text), "+/=", ""), F.translate(F.upper(text), "+/=0189", ""), F.concat(F.lit("sk_live_"), F.translate(text, "+/=", ""))]
    return spark.range(n).select(F.explode(F.array(*[F.substring(x, 1, 40) for x in forms])).alias("token"))


def ordinary_strings(spark: SparkSession, n: int = GENERATED, words: list[str] | None = None, seed: str = "sample") -> DataFrame:
    """(token): generated samples of the label "ordinary", n of each style: two to six words, every other one with a number."""
    vocabulary = F.split(F.lit(" ".join(words or IDENTIFIER_WORDS)), " ")

    def pick(*what, most: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *what), F.lit(most)).cast("int")

    parts = F.transform(F.sequence(F.lit(1), 2 + pick(F.lit("n"), most=5)), lambda k: F.get(vocabulary, F.pmod(F.xxhash64(F.col("id"), F.lit(seed), k), F.size(vocabulary)).cast("int")))
    number = F.when(pick(F.lit("numbered"), most=2) == 1, pick(F.lit("number"), most=1000).cast("string")).otherwise("")

    def styles(p: Column) -> list[Column]:
        titled = F.array_join(F.transform(p, lambda w: F.initcap(w)), "")
        camel = F.concat(F.lower(F.substring(titled, 1, 1)), F.substr(titled, F.lit(2)))
        return [F.concat(x, number) for x in (titled, camel, F.array_join(p, "_"), F.upper(F.array_join(p, "_")), F.array_join(p, "-"), F.concat(F.lit("/"), F.array_join(p, "/")), F.array_join(p, "="))]

    return spark.range(n).select(F.explode(let(parts, lambda p: F.array(*styles(p)))).alias("token"))


def labelled_tokens(df: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(random, token): of a bounded sample of df's distinct texts and of generated strings."""
    spark, rows = df.sparkSession, df.count()
    texts = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if rows > sample_rows:
        texts = texts.where(hash_share(sample_rows / rows, F.col("text")))
    texts, t = texts.distinct(), F.col("text")
    rest = t
    for rule in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, rule, " ")
    values = F.concat(F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= 20), F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    both = texts.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), values.alias("tokens")), F.struct(F.lit(False).alias("random"), F.regexp_extract_all(rest, F.lit(SAMPLE_TOKEN), F.lit(0)).alias("tokens")))).alias("x"))
    found = both.select("x.random", F.explode("x.tokens").alias("token"))
    return found.union(random_strings(spark).select(F.lit(True), "token")).union(ordinary_strings(spark).select(F.lit(False), "token"))


def fit(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each transition; add-one smoothed.

    Of the ordinary label, generated identifiers and the corpus' tokens count alike, whatever their
    numbers. The same rows give the same table however they are partitioned.
    """
    chances = {label: [1.0] * STATES**2 for label in (True, False)}
    for r in transitions(labelled_tokens(df, text, sample_rows)).collect():  # 2 * STATES ** 2 rows at most
        chances[r.random][r.step] += r.n
    ordinary = chances[False]
    for a in range(1, STATES):
        ordinary[a * STATES + a] += RUNS * sum(ordinary[a * STATES : (a + 1) * STATES])
    small, capital = range(27, 53), range(1, 27)
    begun = [sum(ordinary[a * STATES + x] for a in small) for x in capital]
    for a in small:
        humps = sum(ordinary[a * STATES + x] for x in capital) + HUMPS * sum(ordinary[a * STATES : (a + 1) * STATES])
        for x in capital:
            ordinary[a * STATES + x] = humps * begun[x - 1] / sum(begun)
    for label, n in chances.items():
        sums = [sum(n[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        chances[label] = [math.log(x / sums[k // STATES]) for k, x in enumerate(n)]
    return [round(a - b, 4) for a, b in zip(chances[True], chances[False], strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """The token's log-likelihood ratio."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")

    def of(to: Column) -> Column:
        return F.aggregate(
            to, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
            lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.get(values, s["last"] * STATES + x)).alias("sum")),
        )["sum"]

    return let(states(token), of)


def markov_spans(text: Column, table: list[float], least: float = LEAST_RATIO) -> Column:
    """Spans of tokens that the chains call random."""
    return match_spans(text, CANDIDATE, 3, lambda m: ratio(m, table) >= least)


def with_spans(df: DataFrame, text: str, table: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """df's columns as struct ``row``, and base and all spans, which may overlap; markov spans within one base span, which says the same, are left out."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), base_spans(content).alias("base"), markov_spans(content, table, least).alias("markov"))

    def more(spans: Column) -> Column:
        held = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.lit(0), F.greatest)
        marked = F.zip_with(spans, held, lambda s, h: F.struct(s.alias("span"), ((s["kind"] == 3) & (s["end"] <= h)).alias("told")))
        return F.transform(F.filter(marked, lambda m: ~m["told"]), lambda m: m["span"])

    # the order puts base spans before Markov ones of the same start
    both = let(F.array_sort(F.concat("base", "markov")), more)
    return found.select("row", "base", F.when(F.size("markov") == 0, F.col("base")).otherwise(both).alias("spans"))


def scan_secrets(df: DataFrame, text: str = "text", key: str = "doc_id", table: list[float] | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """One row for each row of df: key, n_assign, n_access, n_hex, base_sha256, spans, found.

    found lists all spans as (start, kind, end) in code points, kind being an index of KINDS; spans
    writes them as kind:start:end. A null text counts as empty: no spans, the digest of ''. Without
    any text, the chains are fitted on the generated strings alone. Repeated rows stay; other
    columns, clashing names included, are ignored.
    """
    own = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    found = with_spans(own, "text", table or fit(own, "text"), least)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("row.key").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.col("spans").alias("found"),
    )


def redacted(df: DataFrame, text: str = "text", table: list[float] | None = None, mask: str = "[SECRET]", length: str | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """df with each run of spans in its text replaced by mask; length names a column to hold the new text's code points.

    Rows without a span are untouched, a null text included; no row is dropped.
    """
    found = with_spans(df, text, table or fit(df, text), least)
    source, spans = F.col(f"row.`{text}`").cast("string"), F.col("spans")

    def cut(chunks: Column, spans: Column, size: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            parts = F.transform(F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")), lambda c: F.substr(F.get(chunks, c), F.greatest(a - c * CHUNK, F.lit(0)) + 1, b - F.greatest(a, c * CHUNK)))
            return F.when(b > a, F.array_join(parts, "")).otherwise("")

        ends = running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
        pieces = F.zip_with(spans, ends, lambda s, e: F.when(s["start"] < e, "").otherwise(F.concat(between(e, s["start"]), F.lit(mask))))
        return F.concat(F.array_join(pieces, ""), between(F.array_max(F.transform(spans, lambda s: s["end"])), size))

    fresh_text = let_all([F.regexp_extract_all(source, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), spans, F.char_length(source)], cut)
    fresh = found.select("row", F.size(spans).alias("n"), F.when(F.size(spans) > 0, fresh_text).otherwise(source).alias("cut"))

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == text:
            return F.col("cut").alias(name)
        if name == length:
            return F.when(F.col("n") > 0, F.char_length("cut").cast(df.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return fresh.select(*map(column, df.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("found")
