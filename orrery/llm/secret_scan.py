"""Secret scans by base patterns and two character Markov models, in DataFrame functions only.

Base kinds are `assign`, `access` and `hex` (see PATTERNS). The method adds the kind `markov`:
tokens of TOKEN_CHARS and more with a digit are scored by the sum, over neighbouring characters,
of the logarithm of their transition in random strings over that in ordinary identifiers. A score
above THRESHOLD marks a secret that no base span overlaps. Both models are bigram counts with
additive smoothing, trained from labelled samples: values of base matches and base64 and hex digests as
random strings, other words of the texts as ordinary ones.

Positions are code points, found from the pieces between matches: no row leaves the JVM, nothing
is shuffled but the model's counts. Null texts count as empty. Long texts and any number of
matches are handled whole; repeated rows are scanned each for itself; extra columns are kept
apart; an empty table gives no rows and a model of the digests alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.common import built_once, carried, put_back

VALUE = r"[A-Za-z0-9+/_.=-]+"
# The whole match must have the given number of characters; of `assign`, the value must.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(""" + VALUE + ")", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
# The same matches with less work: runs that are too short are passed over by the pattern itself.
SEARCH = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN_CHARS = 20
RUN = "[A-Za-z0-9+/_=-]"
TOKEN = rf"(?<!{RUN})(?=[A-Za-z+/_=-]*[0-9]){RUN}{{{TOKEN_CHARS},}}"
THRESHOLD = 12.0
SMOOTHING = 0.5
# Bounds of the labelled samples: texts read for ordinary words, texts read for base matches, digests.
PLAIN_TEXTS, SECRET_TEXTS, DIGESTS = 3_000, 40_000, 4_000
MASK = "[SECRET]"


def _matches(text: Column, pattern: str, good) -> Column:
    """(start, end) of each match for which good(match) holds."""
    zipped = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), good(m).alias("good")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(zipped, zero, step, lambda acc: acc["out"])
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(zero["out"])


def base_spans(text: Column, kind: str) -> Column:
    if kind == "assign":
        pattern, group, least = PATTERNS[kind]
        return _matches(text, pattern, lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least)
    return _matches(text, SEARCH[kind], lambda m: m.isNotNull())


def ratio_of(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: random string over ordinary identifier."""
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in ratios) + "', ',') as array<double>)")
    codes = F.transform(F.split(token, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    size = len(ALPHABET)

    def step(acc, code):
        known = (acc["last"] >= 0) & (code >= 0)
        add = F.when(known, F.element_at(table, acc["last"] * size + code + 1)).otherwise(0.0)
        return F.struct(code.alias("last"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def train(labelled: DataFrame) -> list[float]:
    """The log ratio of each transition, first character by first, from rows (token, secret boolean)."""
    chars = labelled.select("secret", F.split("token", "").alias("c"))
    pairs = chars.where(F.size("c") > 1).select(
        "secret", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair")
    ).groupBy("secret", "pair").count()
    size = len(ALPHABET)
    counts = [[SMOOTHING] * (size * size) for _ in range(2)]
    for r in pairs.where(F.translate("pair", ALPHABET, "") == "").collect():  # at most two rows a transition
        a, b = (ALPHABET.index(x) for x in r["pair"])
        counts[bool(r["secret"])][a * size + b] += r["count"]
    out = []
    for a in range(size):
        plain, random = (counts[k][a * size:(a + 1) * size] for k in (0, 1))
        all_plain, all_random = sum(plain), sum(random)
        out += [math.log(r / all_random) - math.log(p / all_plain) for p, r in zip(plain, random, strict=True)]
    return out


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, secret): base values and digests as random strings, other words as ordinary ones."""
    spark = docs.sparkSession
    count = max(1, docs.count())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.where("text IS NOT NULL").select("text", place.alias("place"))
    any_base = "|".join(f"(?:{p})" for p in SEARCH.values())
    value = F.regexp_extract_all("text", F.lit(PATTERNS["assign"][0]), F.lit(2))
    runs = F.regexp_extract_all("text", F.lit(f"{SEARCH['access']}|{SEARCH['hex']}"), F.lit(0))
    secrets = texts.where((F.col("place") < SECRET_TEXTS / count) & F.col("text").rlike(any_base)).select(
        F.explode(F.concat(F.filter(value, lambda v: F.length(v) >= TOKEN_CHARS), runs)).alias("token")
    )
    digest = F.sha2(F.col("id").cast("string"), 512)
    digests = spark.range(DIGESTS).select(F.explode(F.array(F.base64(F.unhex(digest)), digest)).alias("token"))
    plain = texts.where(F.col("place") < PLAIN_TEXTS / count).select(
        F.explode(F.regexp_extract_all(F.regexp_replace("text", any_base, " "), F.lit(f"{RUN}{{4,}}"), F.lit(0))).alias("token")
    )
    return secrets.unionAll(digests).withColumn("secret", F.lit(True)).unionAll(plain.withColumn("secret", F.lit(False)))


def with_spans(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """`docs` with array columns _assign, _access, _hex and _markov of (start, end)."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = built_once(docs, {f"_{k}": base_spans(body, k) for k in PATTERNS} | {
        "_tokens": _matches(body, TOKEN, lambda m: ratio_of(m, ratios) > THRESHOLD)
    })
    base = F.concat("_assign", "_access", "_hex")
    free = F.filter("_tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return built_once(docs, {"_markov": F.when(F.size("_tokens") > 0, free).otherwise(F.col("_tokens"))}).drop("_tokens")


def _named(kinds: list[str]) -> Column:
    """All spans of the kinds as (start, kind's place, end, kind), in that order."""

    def of(at: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(at).alias("at"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ))

    return F.array_sort(F.concat(*[of(at, kind) for at, kind in enumerate(kinds)]))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """doc_id, spans by kind, and their digest for every row of `docs`."""
    ratios = train(labelled_samples(docs)) if ratios is None else ratios
    base, every = list(PATTERNS), [*PATTERNS, "markov"]
    found = with_spans(docs.select("doc_id", "text"), ratios)
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_said(_named(base)), 256).alias("base_sha256"), _said(_named(every)).alias("spans"),
    )


def redact(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """`docs` with every run of overlapping spans in `text` replaced by one MASK and `n_chars`, where there is one, counted anew."""
    names = docs.columns
    found = with_spans(carried(docs, "text"), ratios).withColumn("_spans", _named([*PATTERNS, "markov"]))
    body = F.col("text")

    def step(acc, s):
        cut = F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out")
        )

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    masked = F.aggregate("_spans", zero, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))
    ))
    found = found.withColumn("_text", F.when(F.size("_spans") > 0, masked).otherwise(body))
    changed = {"text": F.col("_text")}
    if "n_chars" in names:
        before = F.col(f"_row.c{names.index('n_chars')}")
        changed["n_chars"] = F.when(F.size("_spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return put_back(found, names, changed)
