"""Secret scan: fixed patterns, and Markov models of random strings against identifiers.

DataFrame functions only: the text never leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import documents, keyed

KINDS = ("assign", "access", "hex", "random")
#: (pattern, group whose length counts, least length). A failing match of the first still uses
#: up its text; of the others a failing match hides no other, so the length is in the pattern.
PATTERNS = (
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    (r"AKIA[A-Z0-9]{12,}", 0, 16),
    (r"[0-9a-f]{32,}", 0, 32),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Runs of the alphabet of so many characters are judged by the models.
LEAST = 20
_RUN = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{LEAST},}}+"
#: The best stretch of a run is a secret if its log-likelihood ratio is above this in all, and
#: this per character pair, and it has so many characters.
TOTAL, MEAN, STRETCH = 12.0, 0.5, 16
#: Counts that the backed-off distribution stands for, so that rare contexts say little.
SMOOTH = 20.0
#: Ordinary words of four languages and of programs.
_WORDS = {
    "en": "the and house water people through between government information children different important question country company system morning language knowledge thought strength weather building machine history science electric photograph rhythm",
    "de": "und nicht werden schiff gesellschaft freundschaft geschichte wissenschaft zwischen strasse arbeit zeitung verkehr bundes haupt bahnhof kraft wirtschaft entwicklung sprache herz pfund jahr tausend zug schule donau dampf",
    "fr": "que pour avec temps monde toujours chose maison jour heure homme femme enfant vie voyage travail beaucoup entreprise quelque nouveau lumiere grand hier eau oeuvre vieux geographie",
    "es": "que para con tiempo mundo siempre cosa casa dia hora hombre mujer nunca vida viaje trabajo mucho empresa alguno nuevo llave calle guerra ciudad querido juego pueblo",
    "code": "get set load read write make find list user account order item file path name value count index page table column cache config session request response client server handler manager service factory builder parser result error message event queue worker buffer stream default current next previous org apache com lib src main java mapreduce http www html json xml utf",
}


def labelled_samples(spark: SparkSession) -> DataFrame:
    """(sample, label): made random strings (1) and ordinary ones (0), the same each time.

    Random ones are digests as hex, base64, letters and digits, and capitals and digits. Ordinary
    ones are words and pairs and triples of words in the styles of prose, identifiers and paths;
    numbers, dates and numbered names; and rules: one character, two in turn, or all in order,
    repeated.
    """
    digest = F.sha2(F.concat(F.lit("vellum"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    letters = F.translate(b64, "+/=", "xY7")
    random = spark.range(2000).select(F.explode(F.array(F.substring(digest, 1, 40), b64, letters, F.upper(letters))).alias("sample"))
    words = F.split(F.lit(" ".join(_WORDS.values())), " ")
    n = sum(len(x.split()) for x in _WORDS.values())
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)) + 1).cast("int"))
    triple = spark.range(6000).select("id", pick(1).alias("u"), pick(2).alias("v"), pick(3).alias("w"))
    joins = [F.concat_ws(c, "u", "v", "w") for c in ("_", "-", "/")]
    styles = F.array(*joins, F.concat("u", F.initcap("v"), F.initcap("w")), F.concat(F.initcap("u"), F.initcap("v")), F.upper(joins[0]), F.concat("u", "v", "w"), F.concat(F.lit("/"), joins[2], F.lit("/")), F.concat_ws("=", "u", "v"))
    ordinary = triple.select(F.explode(styles).alias("sample"))
    day = F.expr("date_add(date'1990-01-01', cast(id * 7 as int))")
    number = F.pmod(F.xxhash64("id"), F.lit(10**15)).cast("string")
    numbers = F.array(number, F.lpad(F.substring(number, 1, 6), 20, "0"), day.cast("string"), F.date_format(day, "yyyyMMdd"), F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(F.substring(number, 1, 3), 6, "0")), F.concat(pick(1), F.lit("_"), F.date_format(day, "yyyyMMdd")), F.concat(pick(2), F.lit("-"), F.substring(number, 1, 2)), F.concat(F.substring(number, 1, 2), F.lit("/"), F.substring(number, 3, 2)), F.lit("01234567890123456789"))
    ordinary = ordinary.unionByName(spark.range(2000).select(F.explode(numbers).alias("sample")))
    one = lambda c: F.substring(F.lit(ALPHABET), (c + 1).cast("int"), F.lit(1))
    rules = spark.range(len(ALPHABET)).select(F.explode(F.array(*[F.repeat(F.concat(one(F.col("id")), *([F.lit(x)] if x else [])), 400 if x else 3000) for x in ("", "-", "_", "=")], F.repeat(F.lit(ALPHABET), 10))).alias("sample"))
    ordinary = ordinary.unionByName(rules)
    return random.withColumn("label", F.lit(1)).unionByName(ordinary.withColumn("label", F.lit(0)))


def log_ratios(samples: DataFrame, smooth: float = SMOOTH) -> list[float]:
    """log P(b after a | random) - log P(b after a | ordinary), at a * size + b.

    ``samples`` has (sample, label), label 1: random, 0: ordinary; nulls and characters outside
    the alphabet are left out. A context's distribution is smoothed by that of all contexts,
    and that by one count a character. Counted in Spark; at most two counts a pair come to the
    driver.
    """
    n = len(ALPHABET)
    codes = F.transform(F.filter(F.split("sample", ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    pairs = samples.where("sample is not null and label is not null").select("label", codes.alias("c")).where(F.size("c") > 1)
    pairs = pairs.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))).alias("p"))
    counts = {0: [[0.0] * n for _ in range(n)], 1: [[0.0] * n for _ in range(n)]}
    for r in pairs.groupBy("label", "p.a", "p.b").count().where("a > 0 and b > 0").collect():
        counts[r["label"]][r["a"] - 1][r["b"] - 1] = r["count"]
    single = {k: [1.0 + sum(counts[k][a][b] for a in range(n)) for b in range(n)] for k in (0, 1)}
    p = lambda k, a, b: (counts[k][a][b] + smooth * single[k][b] / sum(single[k])) / (sum(counts[k][a]) + smooth)
    return [math.log(p(1, a, b)) - math.log(p(0, a, b)) for a in range(n) for b in range(n)]


def pair_ratios(s: Column, table: list[float]) -> Column:
    """The log ratio of each pair of neighbours in a string of the alphabet."""
    n = len(ALPHABET)
    lookup = F.expr(f"array({', '.join(f'{x:.6f}D' for x in table)})")  # one literal, folded when planned
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return F.zip_with(F.slice(codes, 1, F.length(s) - 1), F.slice(codes, 2, F.length(s) - 1), lambda a, b: F.get(lookup, (a - 1) * n + b - 1))


def best_stretch(s: Column, table: list[float]) -> Column:
    """struct(score, a, b): the stretch of pairs with the largest sum, the first on a tie, as characters a to b."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("i"), F.lit(0.0).alias("score"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(acc, x):
        on = acc["sum"] > 0
        total, begin = F.when(on, acc["sum"] + x).otherwise(x), F.when(on, acc["from"]).otherwise(acc["i"])
        better = total > acc["score"]
        return F.struct(total.alias("sum"), begin.alias("from"), (acc["i"] + 1).alias("i"), F.when(better, total).otherwise(acc["score"]).alias("score"), F.when(better, begin).otherwise(acc["a"]).alias("a"), F.when(better, acc["i"] + 2).otherwise(acc["b"]).alias("b"))

    return F.aggregate(pair_ratios(s, table), zero, step, lambda acc: F.struct(acc["score"], acc["a"], acc["b"]))


def spans(docs: DataFrame, table: list[float]) -> DataFrame:
    """(dk, th, kind, begin, end): all spans, kind as an index of KINDS, in code points, end exclusive.

    A text is cut at the matches of each pattern; the lengths of the pieces and matches before a
    match, summed over the text's matches, give its place. Of a run of the alphabet the span is
    its best stretch.
    """
    t = keyed(docs.select("doc_id", "text")).select("dk", "th", F.coalesce("text", F.lit("")).alias("t"))
    found = []
    for kind, (pattern, group, _) in enumerate((*PATTERNS, (_RUN, 0, LEAST))):
        whole = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        counted = F.regexp_extract_all("t", F.lit(pattern), F.lit(group)) if group else whole
        parts = F.zip_with(F.slice(F.split("t", pattern, -1), 1, F.size(whole)), F.arrays_zip(whole.alias("m"), counted.alias("g")), lambda p, m: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), F.length(m["m"]).alias("len"), F.length(m["g"]).alias("counted"), (m["m"] if kind == 3 else F.lit(None).cast("string")).alias("s")))
        numbered = F.transform(parts, lambda x, i: x.withField("i", i))
        found.append(F.when(F.col("t").rlike(pattern), numbered))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,counted:int,s:string,i:int>>")
    rows = t.select("dk", "th", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("x")).select("dk", "th", "x.*").distinct()
    w = Window.partitionBy("dk", "th", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w)).withColumn("begin", F.col("end") - F.col("len"))
    least = F.element_at(F.array(*[F.lit(p[2]) for p in PATTERNS], F.lit(LEAST)), F.col("kind") + 1)
    rows = rows.where(F.col("counted") >= least)
    base = rows.where("kind < 3").select("dk", "th", "kind", "begin", "end")
    runs = rows.where("kind = 3").withColumn("best", best_stretch(F.col("s"), table)).select("dk", "th", "kind", "begin", "best.*")
    length = F.col("b") - F.col("a")
    runs = runs.where((F.col("score") > TOTAL) & (length >= STRETCH) & (F.col("score") > MEAN * (length - 1)))
    return base.unionByName(runs.select("dk", "th", "kind", (F.col("begin") + F.col("a")).alias("begin"), (F.col("begin") + F.col("b")).alias("end")))


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans (arrays) for every row.

    Spans are sorted by begin, then kind. Of each run of LEAST or more characters of the alphabet
    the stretch that is most likely random is judged. A null or empty text has no span; a very
    long one is cut at its matches like any other. Rows that repeat both id and text get the same
    result each. Other columns are ignored; an empty table gives an empty result. ``samples``
    (sample, label) trains the models; by default labelled_samples().
    """
    table = log_ratios(labelled_samples(docs.sparkSession) if samples is None else samples)
    found = spans(docs, table).groupBy("dk", "th").agg(F.sort_array(F.collect_list(F.struct("begin", "kind", "end"))).alias("found"))
    out = keyed(docs.select("doc_id", "text")).select("doc_id", "dk", "th").join(found, ["dk", "th"], "left")
    all_ = F.coalesce("found", F.array().cast("array<struct<begin:bigint,kind:int,end:bigint>>"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda a: F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["begin"].cast("string"), x["end"].cast("string")))
    of = lambda k: F.size(F.filter(all_, lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], named(F.filter(all_, lambda x: x["kind"] < 3)).alias("base_spans"), named(all_).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents."""
    out = scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
