"""Secret scans over a trigram inverted index, in DataFrame operations alone.

Every rule's Boolean trigram query is derived from its regular expression. The index holds a posting
(trigram, document) for the trigrams that the rules name; postings are intersected by document, and only the
candidates' texts are matched against the rule. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, id_key, table
from .trigrams import Clause, query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern for Python's and Java's syntax alike; the least length of its group `group` (0: the match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False
    #: A cheaper pattern that every text with a match that counts meets, for rules that scan everything.
    guard: str | None = None

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern

    @property
    def clauses(self) -> list[Clause]:
        return query(self.pattern)


#: The base rules, in the order in which ties of a start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32, guard=r"[0-9a-f]{32}"),
)
#: What this method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
#: Trigrams that one long holds as bits.
BITS = 62


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for c in r.clauses for s in c for t in s})


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """The inverted index (trigram, doc): a row for each trigram of `words` that occurs in the lower-cased text of a document. Null texts have none; a null id counts as one id."""
    low = docs.select(id_key().alias("doc"), F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.struct(F.lit(w).alias("trigram"), F.contains("low", F.lit(w)).alias("there")) for w in words]), lambda x: x["there"])
    return low.select("doc", F.explode(held).alias("x")).select(F.col("x.trigram").alias("trigram"), "doc")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, rules): the postings intersected by document. The bits of rules name the rules whose query a document meets; a document that meets none has no row. Rows that repeat an id pool their trigrams, which can only add candidates."""
    words = vocabulary(rules)
    bits_of = {w: divmod(i, BITS) for i, w in enumerate(words)}
    numbers = F.create_map(*[F.lit(x) for w, (_, b) in bits_of.items() for x in (w, 1 << b)])
    longs = F.create_map(*[F.lit(x) for w, (m, _) in bits_of.items() for x in (w, m)])
    placed = index.select("doc", numbers[F.col("trigram")].cast("long").alias("bit"), longs[F.col("trigram")].alias("long"))
    masks = placed.groupBy("doc").agg(*[F.coalesce(F.bit_or(F.when(F.col("long") == m, F.col("bit"))), F.lit(0)).cast("long").alias(f"mask{m}") for m in range(-(-len(words) // BITS))])

    def meets(r: Rule) -> Column:
        def all_of(s: frozenset[str]) -> Column:
            out = F.lit(True)
            for m in sorted({bits_of[t][0] for t in s}):
                bits = F.lit(sum(1 << bits_of[t][1] for t in s if bits_of[t][0] == m)).cast("long")
                out = out & (F.col(f"mask{m}").bitwiseAND(bits) == bits)
            return out

        out = F.lit(True)
        for clause in r.clauses:
            one = F.lit(False)
            for s in sorted(clause, key=sorted):
                one = one | all_of(s)
            out = out & one
        return out

    bits = F.lit(0)
    for i, r in enumerate(rules):
        if r.clauses:
            bits = bits + F.when(meets(r), 1 << i).otherwise(0)
    return masks.select("doc", bits.alias("rules")).where("rules <> 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as structs (start, order, end, kind) in code points, leftmost and non-overlapping; those under the least length are dropped after matching. The pieces between the matches give the starts."""
    pattern = F.lit(rule.java)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.transform(F.arrays_zip(F.split(text, rule.java, -1).alias("gap"), found.alias("hit"), sized.alias("part")), lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), F.char_length(x["part"]).alias("part")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        hit = F.array(F.struct(at.alias("start"), F.lit(order).alias("order"), (at + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((at + F.coalesce(x["hit"], F.lit(0))).alias("at"), F.when(x["part"] >= rule.least, F.concat(a["out"], hit)).otherwise(a["out"]).alias("out"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """docs with one more column, last, `secrets` (`secrets_` if docs has one of that name, and so on): an array of (start, order, end, kind), by start and then as the rules are listed.

    A null text is empty and has none; the text is whole whatever its length; repeated rows are each scanned.
    """
    rules = base + more
    doc, met, text, spans = fresh(docs, "__doc", "__rules", "__text", "secrets")
    found = candidates(postings(docs, vocabulary(rules)), rules).withColumnsRenamed({"doc": doc, "rules": met})
    rows = docs.withColumn(doc, id_key()).join(found, doc, "left").withColumn(text, F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        if r.clauses:
            tried = F.coalesce(F.col(met).bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        else:
            tried = F.col(text).rlike(r.guard) if r.guard else F.lit(True)
        parts.append(F.when(tried, spans_of(F.col(text), r, i)).otherwise(none))
    return rows.withColumn(spans, F.array_sort(F.concat(*parts))).drop(doc, met, text)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, order: int) -> Column:
    """How many spans are of the rule of this order. (A second argument of the lambda, even one with a default, would be given the span's index.)"""
    return F.size(F.filter(spans, lambda s: s["order"] == order))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["order"] < len(BASE))
    counts = [count_of(F.col("secrets"), i).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
