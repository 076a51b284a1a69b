"""Audit of filters that hide one another: what each removes under every order of application.

A document is reduced to the set of filters it fails.  Sets of filters applied so far are the states of a lattice whose
edges apply one more filter, and an order of all filters is a path from the empty state to the full one.  What an edge
removes depends on its state alone, not on the order in which the state was reached, so the removals of all edges answer
every order.  Counting forward how many paths reach a state, and backward how many lead on from it, gives the number of
orders that take an edge; weighting its removals by that number gives each filter's Shapley sum without listing orders.

Documents of one part that fail the same filters and agree in their labels are counted once, before anything is shuffled;
the lattice is then worked on for each part and set, a few dozen rows a part whatever the number of documents.

Null texts are empty texts; a null part is the empty string.  Documents without label are neither good nor toxic; of several
labels of one id any positive one counts.  A null id comes after all others.  Rows with equal ids do not make each other
copies; each is counted.  Columns besides the named ones are ignored.  An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veta.llm.common import narrow, query, table
from veta.session import materialise

#: White space between words.
GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def rules(text: str = "text") -> dict[str, Column]:
    """Failure conditions that need the text alone."""
    t = F.col(text)
    return {"A": F.size(words(t)) < 200,
            "B": 100 * F.size(F.array_distinct(words(t))) < 50 * F.size(words(t)),
            "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 3 * F.length(t),
            "D": t.rlike(r"[#$%&*|]")}


@dataclass(frozen=True)
class Edge:
    """One more filter applied to a state, and the number of orders that do so."""

    state: int
    filter: int
    orders: int


def lattice(filters: int) -> list[Edge]:
    """All edges of the lattice of subsets, each with the paths that reach it times the paths that lead on from it."""
    full = (1 << filters) - 1
    levels = [[sum(1 << i for i in chosen) for chosen in combinations(range(filters), size)] for size in range(filters + 1)]
    reaching, leaving = {0: 1}, {full: 1}
    for level in levels[1:]:
        for state in level:
            reaching[state] = sum(reaching[state ^ 1 << i] for i in range(filters) if state >> i & 1)
    for level in reversed(levels[:-1]):
        for state in level:
            leaving[state] = sum(leaving[state | 1 << i] for i in range(filters) if not state >> i & 1)
    return [Edge(s, i, reaching[s] * leaving[s | 1 << i]) for level in levels for s in level for i in range(filters) if not s >> i & 1]


def literals(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]))


def failures(docs: DataFrame, conditions: Mapping[str, Column], copies: str | None, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, digest, fails int) of every row; bit i of ``fails`` stands for the i-th condition, the last one for ``copies``.

    A row fails ``copies`` if a row with a smaller key has the same text.  Texts are told apart by SHA-256.  A row is no copy
    if (text, key) is the first of its text, which is a join on both: a text that a third of all rows share is spread by
    its keys.
    """
    frame = narrow(docs, key=key, part=part, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())]
    own = frame.select("key", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2("text", 256)).alias("digest"),
                       sum(bits[1:], bits[0]).cast("int").alias("fails"))
    if copies is None:
        return own
    # Null keys are one value in the comparison below, and the last in order.
    named = own.withColumn("name", F.coalesce(F.col("key").cast("string"), F.lit("null")))
    least = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("k"), F.col("name").alias("name")))
    first = named.groupBy("digest").agg(least.alias("m")).select("digest", F.col("m.name").alias("name"), F.lit(True).alias("first"))
    late = F.when(F.col("first").isNull(), F.lit(1 << len(conditions))).otherwise(F.lit(0))
    return named.join(first, ["digest", "name"], "left").select("key", "part", "digest", (F.col("fails") + late).cast("int").alias("fails"))


def tallies(failed: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, fails, n, good, toxic): documents, good and toxic ones, of each part and set of failed filters."""
    marks = narrow(labels, key=key, q=quality, t=toxic).where("key IS NOT NULL")
    marks = marks.groupBy("key").agg(F.max(F.coalesce(F.col("q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("t") == 1, F.lit(False))).alias("toxic"))
    # Null keys have no label; a second column spreads them.
    rows = failed.withColumn("salt", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    both = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["key", "salt"], "left")
    return both.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))


def edges(counts: DataFrame, filters: int) -> DataFrame:
    """(part, state, filter, ``COUNTS``, orders) of every edge and part."""
    placed = counts.select("*", literals([(e.state, e.filter, e.orders) for e in lattice(filters)], ["state", "filter", "orders"]).alias("e")).select("*", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    alive = F.col("fails").bitwiseAND(F.col("state")) == 0
    fails = F.col("fails").bitwiseAND(bit) != 0
    total = lambda name, when: F.coalesce(F.sum(F.when(when, F.col(name))), F.lit(0).cast("long"))
    return placed.groupBy("part", "state", "filter").agg(
        total("n", alive & ~fails).alias("kept"), total("n", alive & fails).alias("removed"), total("n", ~alive & fails).alias("redundant"),
        total("n", F.col("fails") == bit).alias("unique_fails"), total("good", alive & fails).alias("good_lost"), total("toxic", alive & fails).alias("toxic_lost"),
        F.first("orders").cast("long").alias("orders"))


def shapley(found: DataFrame) -> DataFrame:
    """(part, filter, shapley): removals of each filter over all orders."""
    return found.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))


def steps(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, ``COUNTS``) of every order of the filters, read from the edges."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(names[j] for j in order), step, state, i))
            state |= 1 << i
    # An edge is read by all orders that take it: the orders are laid under their edge, and each edge row unfolds once.
    taken: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order, step, state, i in rows:
        taken.setdefault((state, i), []).append((order, step))
    spark = found.sparkSession
    book = spark.createDataFrame([(s, i, o) for (s, i), o in taken.items()], "state int, filter int, orders array<struct<filter_order:string,step:int>>")
    return (found.drop("orders").join(F.broadcast(book), ["state", "filter"]).select("part", "filter", *COUNTS, F.explode("orders").alias("o"))
            .select("part", "filter", "o.filter_order", "o.step", *COUNTS))


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None, copies: str | None = "E", part: str = "lang", key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(part, filter_order, step, ``COUNTS``, shapley) for every part, order and step.

    ``conditions`` names the filters that look at a row alone, by default ``rules``; ``copies`` names the one for repeated
    texts (None: without).  The result has one row for each of the orders, so there should be few filters.
    """
    given = dict(conditions if conditions is not None else rules("text"))
    names = [*given, *([copies] if copies else [])]
    # Written once, a row a part and set of filters: the edges are read for the steps and for the sums.
    found = edges(materialise(tallies(failures(docs, given, copies, part, key, text), labels, key)), len(names))
    return steps(found, names).join(shapley(found), ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
    b AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (first < doc_id)::INT AS fails FROM w),
    g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM b LEFT JOIN g USING (doc_id) GROUP BY ALL),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
    s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
    r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
        good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


@query("op12_filter_audit", ORACLE)
def op12_filter_audit(spark, sf):
    return audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
