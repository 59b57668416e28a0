"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for urls that no rule fits.

DataFrame expressions only. The urls that a rule fits are the labelled ones. They are counted by their binned features once,
and each boosting round asks that table, level by level, for one aggregate: sums of gradients (fixed-point, so that any order
of adding gives the same sum) per node, feature and bin, which is of a fixed size and goes to the driver; the split it picks
becomes a CASE expression. Scoring is one expression over the url. The share of blocked urls under a suffix is taken out of
fold: a labelled url reads it from urls of hosts in the other FOLDS, never from its own label or its host's.

Defined results: null url or no ``://`` - empty host and path, no rule, the trees' verdict; null page_id - kept; no labelled
urls - score 0.5, allow; urls of any length are read whole; repeated rows - judged alike, each counts in training; splits of
equal gain - the first feature and the lowest bin; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut

#: verdict, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UNIT = 10**9
FOLDS = 5
LEAN = 20  # labelled urls that the share over all suffixes counts for in that of one
#: upper bounds of the bins of each feature; a value beyond the last has a bin of its own
BINS = {
    "url_length": (16, 24, 32, 40, 48, 64, 96, 160),
    "host_length": (8, 12, 16, 20, 24, 32, 48),
    "path_length": (1, 4, 6, 8, 10, 12, 16, 24, 48),
    "host_depth": (0, 1, 2, 3, 4),
    "path_depth": (0, 1, 2, 3, 4, 6),
    "digit_ratio": (0.0, 0.02, 0.05, 0.08, 0.12, 0.2, 0.4),
    "hyphens": (0, 1, 2, 4),
    "parameters": (0, 1, 2, 3, 5),
    "entropy": (2.0, 2.5, 2.8, 3.0, 3.2, 3.4, 3.7, 4.0),
    "suffix_share": (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.7),
    "suffix_block": (0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98),
}


@dataclass(frozen=True)
class Split:
    feature: str
    bin: int
    left: float | Split
    right: float | Split


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract words them; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = None
    for word, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Bits a character: the sorted characters make runs, one a sign."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.aggregate(runs, F.lit(0.0), lambda s, r: s - F.length(r) / n * F.log2(F.length(r) / n))


def lexical(pages: DataFrame, rules, train: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, y (1 block, 0 allow, null: no label or not to train on), and the features of each url."""
    pages = columns(pages, "page_id", "url")
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = parts(url)
    df = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "verdict": verdict})
    y = (F.col("verdict") == "block").cast("int")
    df = df.withColumns({"y": y if train is None else F.when(train, y), "suffix": F.substring_index("host", ".", -1), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS))})
    length = F.length("url")
    df = df.withColumns(
        {
            "url_length": length,
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "host_depth": F.regexp_count("host", F.lit(r"\.")),
            "path_depth": F.regexp_count("path", F.lit("/")),
            "digit_ratio": F.regexp_count("url", F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
            "hyphens": F.regexp_count("host", F.lit("-")),
            "parameters": F.regexp_count("url", F.lit("[?&][^?&#]+")),
            "entropy": _entropy(F.col("host")),
        }
    )
    # a row a suffix and fold; sizes decide whether Spark sends it round or deals both sides
    of_fold = df.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("y").alias("own_n"), F.coalesce(F.sum("y"), F.lit(0)).alias("own_y"))
    of_suffix = of_fold.groupBy("suffix").agg(F.sum("n").alias("same"), F.sum("own_n").alias("all_n"), F.sum("own_y").alias("all_y"))
    every = of_suffix.agg(F.sum("same").alias("pages"), ((F.sum("all_y") + 1) / (F.sum("all_n") + 2)).alias("mean"))
    shares = of_fold.drop("n").join(of_suffix, "suffix").join(F.broadcast(every))  # one row
    out = F.when(F.col("y").isNotNull(), 1).otherwise(0)
    block = (F.col("all_y") - out * F.col("own_y") + LEAN * F.col("mean")) / (F.col("all_n") - out * F.col("own_n") + LEAN)
    return df.join(shares, ["suffix", "fold"]).withColumns({"suffix_share": F.col("same") / F.col("pages"), "suffix_block": block})


def _bin(name: str) -> Column:
    out = None
    for i, top in enumerate(BINS[name]):
        out = F.when(F.col(name) <= top, i) if out is None else out.when(F.col(name) <= top, i)
    return out.otherwise(len(BINS[name]))


def value(tree: float | Split) -> Column:
    """A tree over binned features as an expression."""
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(F.col(f"b_{tree.feature}") <= tree.bin, value(tree.left)).otherwise(value(tree.right))


def best(sums: dict[tuple[str, int], tuple[float, float]], ridge: float) -> tuple[str, int, tuple, tuple] | None:
    """The split with the largest gain, with (g, h) of its sides; ties go to the first feature and the lowest bin. sums: (feature, bin) to (g, h)."""
    found, most = None, 1e-6
    for name in BINS:
        cells = [sums.get((name, b), (0.0, 0.0)) for b in range(len(BINS[name]) + 1)]
        g, h = sum(c[0] for c in cells), sum(c[1] for c in cells)
        left_g = left_h = 0.0
        for b, cell in enumerate(cells[:-1]):
            left_g, left_h = left_g + cell[0], left_h + cell[1]
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if round(gain, 6) > most:
                found, most = (name, b, (left_g, left_h), (g - left_g, h - left_h)), round(gain, 6)
    return found


def boost(labelled: DataFrame, rounds: int = 10, depth: int = 3, rate: float = 0.5, ridge: float = 1.0) -> list[float | Split]:
    """Trees fitted to (b_<feature> ..., y) by second-order gradient boosting on the logistic loss."""
    held = cut(labelled.groupBy("y", *[f"b_{n}" for n in BINS]).agg(F.count("*").alias("w")))
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"b_{n}").alias("bin")) for n in BINS]
    trees: list[float | Split] = []
    for _ in range(rounds):
        score = sum((value(t) for t in trees), F.lit(0.0))
        df = held.withColumn("p", 1 / (1 + F.exp(-score)))
        df = df.withColumns({"g": F.round((F.col("p") - F.col("y")) * UNIT).cast("long") * F.col("w"), "h": F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long") * F.col("w")})
        splits: dict[str, tuple[str, int]] = {}
        totals: dict[str, tuple[float, float]] = {}
        node = F.lit("")
        for level in range(depth):
            rows = df.withColumn("node", node).where(F.length("node") == level)
            rows = rows.select("node", "g", "h", F.explode(F.array(*cells)).alias("cell")).groupBy("node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            sums: dict[str, dict] = {}
            for r in rows.collect():  # nodes x features x bins
                sums.setdefault(r["node"], {})[(r["cell"]["feature"], r["cell"]["bin"])] = (r["g"] / UNIT, r["h"] / UNIT)
            if not level:
                if not sums:
                    return trees
                first = next(iter(BINS))
                totals[""] = tuple(sum(v[i] for (f, _b), v in sums[""].items() if f == first) for i in (0, 1))
            step = node
            for name, cell in sums.items():
                if s := best(cell, ridge):
                    splits[name], totals[name + "l"], totals[name + "r"] = s[:2], s[2], s[3]
                    step = F.when(node == name, F.when(F.col(f"b_{s[0]}") <= s[1], F.lit(name + "l")).otherwise(F.lit(name + "r"))).otherwise(step)
            if not any(len(n) == level for n in splits):
                break
            node = step

        def build(name: str) -> float | Split:
            if name in splits:
                return Split(*splits[name], build(name + "l"), build(name + "r"))
            g, h = totals[name]
            return -rate * g / (h + ridge)

        trees.append(build(""))
    return trees


def features_used(trees: list[float | Split]) -> set[str]:
    """Names of the features that the trees split on."""
    return set().union(*({t.feature} | features_used([t.left, t.right]) for t in trees if isinstance(t, Split)))


def judge(pages: DataFrame, rules=RULES, train: Column | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, score (probability of block by the trees).

    train: which of the urls that a rule fits (by host, path, rule) the trees may learn from; all of them if not given.
    """
    df = lexical(pages, rules, train)
    df = df.withColumns({f"b_{n}": _bin(n) for n in BINS})
    df = cut(df.select("page_id", "host", "path", "rule", "verdict", "y", *[f"b_{n}" for n in BINS]))
    trees = boost(df.where("y is not null").select("y", *[f"b_{n}" for n in BINS]))
    score = 1 / (1 + F.exp(-sum((value(t) for t in trees), F.lit(0.0))))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return df.withColumn("score", score).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def margin(trees: list[float | Split], bins: dict[str, int]) -> float:
    """What the trees say of one row, in plain Python (for tests)."""

    def walk(t: float | Split) -> float:
        while isinstance(t, Split):
            t = t.left if bins[t.feature] <= t.bin else t.right
        return t

    return math.fsum(walk(t) for t in trees)
