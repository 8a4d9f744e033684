"""Quality rules: a decision list learned from labelled statistics, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bind, fold, free_prefix, stored, words

#: Measures whose thresholds the rules use.
MEASURES = ("q_words", "q_word_len", "q_symbols", "q_dup_lines", "q_repeats", "q_upper", "q_marks", "q_digits", "q_bars")
EDGES = 16  # quantiles of each class at which a threshold may lie
MAX_RULES = 12  # of a list
MAX_FAILED = 4  # rules that may turn out not to be precise before learning ends
MAX_LITERALS = 3  # thresholds of a rule
SAMPLE = 50_000  # labelled rows that teach the rules, at most
MIN_COVER = 5  # labelled rows that a rule must reject
PRECISION = 0.9  # of a rule, on the rows held out for pruning


def repeat_words(ws: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash. Only texts with an equal pair are sorted; then the starts of repeated windows
    in order give min(3, distance to the next) words each.
    """

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                before = F.when(j > 0, F.get(s, j - 1)["h"])
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def total(starts: Column) -> Column:
            return F.aggregate(F.transform(starts, lambda p, j: F.coalesce(F.least(F.lit(3), F.get(starts, j + 1) - p), F.lit(3))), F.lit(0), lambda a, b: a + b)

        return bind(bind(ranked, repeated), total)

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return of(ws).cast("long")


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """docs with the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and MEASURES, all of whose names begin with prefix.

    Null counts as the empty text, which has no words and zero for every measure.
    """
    text = F.col(f"`{text_col}`")
    t = F.coalesce(text, F.lit(""))
    of = lambda name: F.col(prefix + name)
    removed = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    counts = {
        "counts": bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
        "n_symbols": removed("#*$%&|<>"),
        "n_upper": removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": removed("!?"),
        "n_digits": removed("0123456789"),
        "n_bars": removed("|{}[]\\/=~^_"),
        "n_lines": (removed("\n") + 1),
    }
    n = F.greatest(of("counts.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(of("word_chars"), F.lit(1)).cast("double")
    shares = {
        "n_words": of("counts.n_words"),
        "n_repeat_words": of("counts.n_repeat_words"),
        "words": of("counts.n_words").cast("double"),
        "word_len": of("word_chars") / n,
        "symbols": of("n_symbols") / n,
        "dup_lines": of("n_dup_lines") / of("n_lines"),
        "repeats": of("counts.n_repeat_words") / n,
        "upper": of("n_upper") / chars,
        "marks": of("n_marks") / n,
        "digits": of("n_digits") / chars,
        "bars": of("n_bars") / n,
    }
    named = lambda columns: {prefix + k: v for k, v in columns.items()}
    return docs.withColumns(named(counts)).withColumns(named(shares)).drop(f"{prefix}counts")


def base_failed(prefix: str = "q_") -> Column:
    n, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (repeats * 100 > n * 50)


@dataclass(frozen=True)
class Literal:
    measure: str
    above: bool
    edge: float

    def column(self, prefix: str = "q_") -> Column:
        value = F.col(prefix + self.measure.removeprefix("q_"))
        return value > self.edge if self.above else value <= self.edge

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.edge:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds that rejects, with the rows it rejects in the rows held out: right and wrong."""

    literals: tuple[Literal, ...]
    right: int = 0
    wrong: int = 0

    def column(self, prefix: str = "q_") -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column(prefix)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals)) + f"  [{self.right} right, {self.wrong} wrong]"


@dataclass
class DecisionList:
    """Rules in order, then the default: keep."""

    rules: list[Rule] = field(default_factory=list)

    def column(self, prefix: str = "q_") -> Column:
        """0 for keep, else the number of the first rule that rejects."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(prefix), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {r}" for k, r in enumerate(self.rules, 1)) + "\nelse keep"


def learn(labelled: DataFrame, reject_col: str) -> DecisionList:
    """A decision list for rejecting rows, from all rows of `labelled` (measures, boolean reject_col, q_prune).

    Sequential covering: a rule grows by the threshold that most raises the weighted log odds (FOIL gain) on growing rows, until
    it rejects no row to keep or has MAX_LITERALS; it is pruned to the leading literals that do best on rows held out
    for pruning; it stays if it is precise there, and what it rejects is put aside. A rule that is not precise is dropped and the next
    one begins with another threshold, until MAX_FAILED were dropped. Only counts by measure and
    threshold come to the driver: at most 2 * EDGES for each measure.
    """
    edges: dict[str, list[float]] = {m: [] for m in MEASURES}
    cuts = [k / EDGES for k in range(1, EDGES)]
    for row in labelled.groupBy(reject_col).agg(*[F.percentile_approx(m, cuts, 2000).alias(m) for m in MEASURES]).collect():
        for m in MEASURES:
            edges[m] += [float(x) for x in row[m] or [] if x == x]
    # half way to the next value, so that a threshold does not sit on a value that both classes have
    edges = {m: sorted(set(v)) for m, v in edges.items()}
    edges = {m: sorted({*v, *[(a + b) / 2 for a, b in zip(v, v[1:])]}) for m, v in edges.items()}

    def place(m: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges[m]]).cast("array<double>"), lambda e: e < F.col(m)))

    coded = stored(labelled.select(*MEASURES, F.col(reject_col).alias("q_reject"), "q_prune", F.array(*[place(m) for m in MEASURES]).alias("q_at")), "quality-coded")

    def counts(rows: DataFrame) -> dict[str, list[list[int]]]:
        """Rows to reject and to keep by measure and place, of the growing rows."""
        got = {m: [[0, 0] for _ in range(len(edges[m]) + 1)] for m in MEASURES}
        told = rows.where(~F.col("q_prune")).select("q_reject", F.posexplode("q_at").alias("m", "at"))
        for r in told.groupBy("m", "at").agg(F.count_if("q_reject").alias("p"), F.count_if(~F.col("q_reject")).alias("n")).collect():
            got[MEASURES[r["m"]]][r["at"]] = [r["p"], r["n"]]
        return got

    import math

    rules: list[Rule] = []
    left, failed = coded, set()
    while len(rules) < MAX_RULES and len(failed) < MAX_FAILED:
        body: list[Literal] = []
        rows = left
        while len(body) < MAX_LITERALS:
            hist = counts(rows)
            p0, n0 = (sum(c[i] for c in hist[MEASURES[0]]) for i in (0, 1))
            if p0 < MIN_COVER or n0 == 0:
                break
            best, gain = None, 1e-9
            for m in MEASURES:
                p = n = 0
                for edge, (dp, dn) in zip(edges[m], hist[m]):  # the rows at most edge
                    p, n = p + dp, n + dn
                    for above, q, k in ((False, p, n), (True, p0 - p, n0 - n)):
                        if q >= MIN_COVER and (body or (m, above, edge) not in failed) and (g := q * (math.log((q + 1) / (q + k + 2)) - math.log((p0 + 1) / (p0 + n0 + 2)))) > gain:
                            best, gain = Literal(m, above, edge), g
            if best is None:
                break
            body.append(best)
            rows = rows.where(best.column())
        if not body:
            break
        sums, cond = [], F.col("q_prune")
        for k, x in enumerate(body):
            cond = cond & x.column()
            sums += [F.count_if(cond & F.col("q_reject")).alias(f"p{k}"), F.count_if(cond & ~F.col("q_reject")).alias(f"n{k}")]
        seen = left.agg(*sums).first()
        worth = [(seen[f"p{k}"] - seen[f"n{k}"]) / (seen[f"p{k}"] + seen[f"n{k}"] + 1) for k in range(len(body))]
        k = worth.index(max(worth))
        rule = Rule(tuple(body[: k + 1]), seen[f"p{k}"], seen[f"n{k}"])
        if rule.right + 1 < PRECISION * (rule.right + rule.wrong + 1) or rule.right == 0:
            failed.add((body[0].measure, body[0].above, body[0].edge))
            continue
        rules.append(rule)
        left = left.where(~rule.column())
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """Learn from the rows of docs that labels names; label 0 means reject, null labels are left out.

    At most SAMPLE labels are used, drawn by a hash of the id: so many are broadcast, and texts need no shuffle. A document
    with several labels counts once for each. Documents that fail the base rules teach nothing: they are
    rejected anyway. Without labelled rows the list is empty and keeps everything.
    """
    of = lambda c: F.col(f"`{c}`")
    told = labels.where(of(label_col).isNotNull() & of(id_col).isNotNull()).select(of(id_col).alias("q_id"), (of(label_col) == 0).alias("q_bad"))
    told = told.orderBy(F.xxhash64("q_id"), "q_id", "q_bad").limit(SAMPLE)
    known = docs.select(of(id_col).alias("q_id"), of(text_col).alias("q_text")).join(F.broadcast(told), "q_id")
    rows = measured(known, "q_text").withColumn("q_prune", fold(F.col("q_id"), 3) == 0).withColumn("q_failed", base_failed())
    # the filter comes after the table, so that it does not draw the measures below the join
    rows = stored(rows.select(*MEASURES, "q_bad", "q_prune", "q_failed"), "quality-labelled").where(~F.col("q_failed"))
    return learn(rows, "q_bad")


def prefix_of(docs: DataFrame) -> str:
    """What the new columns of judge(docs) begin with."""
    return free_prefix("q_", docs.columns)


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, rule (0: none) and kept; their names begin with q_, or with prefix_of(docs) where docs has such columns.

    A null or empty text has no words and fails the base rules; repeated rows are judged alike; other columns stay as they are."""
    p = prefix_of(docs)
    out = measured(docs, text_col, p).withColumn(f"{p}base_failed", base_failed(p)).withColumn(f"{p}rule", rules.column(p))
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}rule") == 0))
