"""Mixing sources to target weights (operator 3): soft membership of every document, then rates that meet token targets.

1. A naive-Bayes classifier over hashed words is trained from a labelled table and gives every document a posterior over
   the domains (``soft membership``). Training reads a bounded sample of the labelled rows (``train_rows``), counts are
   grouped aggregates over ``BUCKETS`` word buckets and the domains, so the fitted table has a fixed size.
2. With a[i,d] = tokens_i * p[i,d], rates r >= 0 minimise the squared distance of sum_i r_i a[i,.] from the targets T, in
   the metric of G = sum_i tokens_i p_i p_i' : projected gradient steps r_i <- max(0, r_i - p_i . G^-1 (sum_j r_j a[j,.] - T)),
   whose step length is one, taken from a little ahead (momentum, begun anew when the distance grows). Each is one distributed
   aggregate of D sums; a document's rate is a fold over the steps so far, written down every few steps.
3. A rate becomes copies: floor(rate), and one more when a hash of the document's key falls under the fraction.

Everything is DataFrame expressions; the driver sees the fitted tables and D sums a step.
Defined cases: a null or wordless text has 0 tokens, the domains' prior as posterior, and the rate fitted for that; labels
of unknown documents are unused; without any labelled document every document belongs to ``unlabelled`` alone; an empty
table gives no rows; targets that no rates can meet are met as nearly as can be, without a word; if no
target names a domain that there is, every rate is 1; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

BUCKETS = 4096
TRAIN_ROWS = 20_000
#: Tokens are words: runs without white space.
WORD = r"[^\x20\x09-\x0D]+"


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], dict[str, float], dict[str, list[float]]]:
    """Domains, their log priors, and log P(bucket | domain) with add-one smoothing.

    ``labelled``: doc_id, domain. The sample is the ``train_rows`` labelled rows with the least hashes.
    """
    labelled = labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    if not sizes:
        return ["unlabelled"], {"unlabelled": 0.0}, {"unlabelled": [0.0] * BUCKETS}
    total, domains = sum(sizes.values()), sorted(sizes)
    sample = labelled.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(train_rows)
    # At most train_rows pairs of an id and a domain: small enough for every task, so no text is shuffled.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample.select("doc_id", "domain")), "doc_id")
    counts = (
        texts.select("domain", F.explode(_words(F.col("text"))).alias("w"))
        .groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect()
    )
    import math

    table_ = {d: [1.0] * BUCKETS for d in domains}
    for r in counts:
        table_[r["domain"]][r["b"]] += r["n"]
    sums = {d: sum(table_[d]) for d in domains}
    return (
        domains,
        {d: math.log(sizes[d] / total) for d in domains},
        {d: [math.log(x / sums[d]) for x in table_[d]] for d in domains},
    )


def _numbers(values: list[float]) -> Column:
    """A constant array as one literal, which is parsed once: thousands of literals would be slow to plan."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def posteriors(docs: DataFrame, domains: list[str], prior: dict[str, float], likelihood: dict[str, list[float]]) -> DataFrame:
    """_row key, tokens, p (array over ``domains``) of every row; words are exploded and summed again in the same task.

    Rows are keyed by (doc_id, digest of the text), so repeated rows share one line with their number ``copies``.
    A log-likelihood ratio is divided by the square root of the tokens, which keeps long texts' memberships soft.
    """
    keyed = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_h"), text_or_empty().alias("text"))
    one = keyed.select("doc_id", "_h", F.explode_outer(_words(F.col("text"))).alias("w"))
    base = likelihood[domains[0]]
    scored = one.select("doc_id", "_h", "w", _bucket(F.col("w")).alias("b"))
    sums = [
        F.sum(F.element_at(_numbers([likelihood[d][b] - base[b] for b in range(BUCKETS)]), F.col("b") + 1)).alias(f"s{k}")
        for k, d in enumerate(domains[1:], 1)
    ]
    agg = scored.groupBy("doc_id", "_h").agg(F.count("w").alias("tokens"), *sums)
    scale = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)).cast("double"))
    logits = [F.lit(prior[domains[0]])] + [
        F.lit(prior[d]) + F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / scale for k, d in enumerate(domains[1:], 1)
    ]
    logits = F.array(*logits)
    top = F.array_max(logits)
    agg = agg.withColumn("z", F.transform(logits, lambda x: F.exp(x - top)))
    norm = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return agg.select("doc_id", "_h", "tokens", F.transform("z", lambda x: x / norm).alias("p"))


#: Steps that are one expression; after so many, rates are written down and the next begin from there.
STEPS_AT_ONCE = 8
#: Over so many steps the distance must fall by a hundredth; else the rates are as near as they get.
PATIENCE = 10


def _after(steps: list[tuple[float, list[float]]]) -> Column:
    """The rate, and the one before it, after further steps (momentum, movement in each domain): a fold over the row alone."""
    plan = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*map(F.lit, g)).alias("g")) for m, g in steps])

    def step(state: Column, s: Column) -> Column:
        ahead = state["rate"] + s["m"] * (state["rate"] - state["prior"])
        move = F.aggregate(F.zip_with("p", s["g"], lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        return F.struct(F.greatest(F.lit(0.0), ahead - move).alias("rate"), state["rate"].alias("prior"))

    return F.aggregate(plan, F.struct(F.col("rate"), F.col("prior")), step)


def _solve(gram: list[list[float]], x: list[float]) -> list[float]:
    """gram^-1 x for a few dimensions; a little on the diagonal makes empty or equal domains harmless."""
    n = len(x)
    ridge = 1e-9 * (sum(gram[i][i] for i in range(n)) or 1.0)
    a = [[gram[i][j] + (ridge if i == j else 0.0) for j in range(n)] + [x[i]] for i in range(n)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[pivot] = a[pivot], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [u - f * v for u, v in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], tokens: float | None = None,
              tolerance: float = 1e-4, most_steps: int = 400) -> tuple[DataFrame, int]:
    """``members`` with ``rate``, and the number of steps. ``targets``: weight of each domain, normalised; ``tokens``: the
    total wanted (default: as many as there are). Stops when no domain is off by more than ``tolerance`` of the total, or when
    steps hardly lessen the distance: the targets are then out of reach. RuntimeError if neither comes within ``most_steps``."""
    dims = range(len(domains))
    p = [F.element_at("p", d + 1) for d in dims]
    sums = lambda r: [F.coalesce(F.sum(r * F.col("tokens") * p[d]), F.lit(0.0)) for d in dims]
    members = members.withColumn("rate", F.lit(1.0)).withColumn("prior", F.lit(1.0))
    pairs = [F.coalesce(F.sum(F.col("tokens") * p[i] * p[j]), F.lit(0.0)) for i in dims for j in dims]
    got, *flat = (lambda row: (list(row[: len(domains)]), *row[len(domains) :]))(members.agg(*sums(F.col("rate")), *pairs).first())
    gram = [flat[i * len(domains) : (i + 1) * len(domains)] for i in dims]
    total = sum(got) if tokens is None else tokens
    weight = sum(targets.get(d, 0.0) for d in domains)
    if not weight:
        return members.drop("prior"), 0
    wanted = [total * targets.get(d, 0.0) / weight for d in domains]

    def off(sums: list[float]) -> list[float]:
        return [g - w for g, w in zip(sums, wanted)]

    def distance(sums: list[float]) -> float:
        return sum(x * y for x, y in zip(off(sums), _solve(gram, off(sums))))

    fresh: list[tuple[float, list[float]]] = []
    done, age, last, ways = 0, 1.0, got, [distance(got)]
    while total and max(map(abs, off(got))) > tolerance * total and not (done >= PATIENCE and ways[-1] > 0.99 * ways[-1 - PATIENCE]):
        if done == most_steps:
            raise RuntimeError(f"rates have not settled after {most_steps} steps: {got} instead of {wanted} tokens")
        if len(fresh) == STEPS_AT_ONCE:
            moved = members.withColumn("_s", _after(fresh)).withColumn("rate", F.col("_s")["rate"]).withColumn("prior", F.col("_s")["prior"])
            members, fresh = materialize(moved.drop("_s"), "rates"), []
        older, age = age, (1 + (1 + 4 * age * age) ** 0.5) / 2
        momentum = (older - 1) / age
        fresh.append((momentum, _solve(gram, off([g + momentum * (g - x) for g, x in zip(got, last)]))))
        last, got = got, list(members.agg(*sums(_after(fresh)["rate"])).first())
        done += 1
        ways.append(distance(got))
        if ways[-1] > ways[-2]:
            age = 1.0
    return members.withColumn("rate", _after(fresh)["rate"] if fresh else F.col("rate")).drop("prior"), done


#: Production weights of the domains that the labels table defines.
TARGETS = {"high": 0.75, "low": 0.2, "toxic": 0.05}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, tokens: float | None = None) -> DataFrame:
    """doc_id, _h (hash of the text), tokens, domains' posterior p, rate, copies of every distinct (doc_id, text)."""
    labelled = labels.select("doc_id", label_domain().alias("domain"))
    model = train(docs, labelled)
    members = materialize(posteriors(docs, *model), "memberships")
    fitted, _ = fit_rates(members, model[0], targets, tokens)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.col("_h"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(F.col("rate"))
    copies = whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)
    return fitted.withColumn("copies", copies.cast("int")).withColumn("domains", F.lit(model[0]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
    return out.select(
        "doc_id", "tokens", F.element_at("domains", 1 - best["i"]).alias("domain"),
        F.col("p").alias("posterior"), "rate", "copies",
    )


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, tokens: float | None = None) -> DataFrame:
    """The documents repeated by their copies; those of none go. Columns stay as they are."""
    plan = mix(docs, labels, targets, tokens).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_th"), "copies")
    joined = docs.join(plan, docs["doc_id"].eqNullSafe(plan["_id"]) & (F.xxhash64(text_or_empty()) == plan["_th"]))
    names = docs.columns
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[docs[c] for c in names])
