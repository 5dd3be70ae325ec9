"""Horn rules over facts (pred, args): forward chaining, depth, proofs, goals, retraction, contradictions.

Facts are rows (pred, args array<string>). A rule's body is a chain of equi-joins on shared variables; capitalised arguments are variables. Evaluation is
semi-naive: each round only joins what has at least one fact of the last round. Every round is written to the shared folder, which cuts the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.sources.shared import written

COMPACT = 8  # rounds
Atom = tuple[str, ...]
SCHEMA = "pred string, args array<string>"


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]

    def __post_init__(self) -> None:
        known = {t for a in self.body for t in a[1:] if variable(t)}
        if not self.body or any(variable(a[0]) for a in (self.head, *self.body)):
            raise ValueError("a rule needs a body, and a predicate can't be a variable")
        if loose := {t for t in self.head[1:] if variable(t)} - known:
            raise ValueError(f"unbound in the body: {sorted(loose)}")


def variable(term: str) -> bool:
    return term[:1].isupper()


def matched(facts: DataFrame, atom: Atom, k: int) -> DataFrame:
    """The facts that match an atom, a column per variable, and the fact itself as premise k."""
    rows = facts.where((F.col("pred") == atom[0]) & (F.size("args") == len(atom) - 1))
    columns: dict[str, Column] = {}
    for i, term in enumerate(atom[1:]):
        value = F.col("args")[i]
        if not variable(term):
            rows = rows.where(value == term)
        elif term in columns:
            rows = rows.where(value == columns[term])
        else:
            columns[term] = value
    return rows.select(*[c.alias(t) for t, c in columns.items()], F.struct("pred", "args").alias(f"premise_{k}"))


def connected(body: tuple[Atom, ...], first: int) -> list[int]:
    """The atoms in an order from `first` on in which each shares a variable with one before it, where the rule allows."""
    order, rest = [first], [k for k in range(len(body)) if k != first]
    while rest:
        known = {t for k in order for t in body[k][1:] if variable(t)}
        order.append(rest.pop(next((n for n, k in enumerate(rest) if known & set(body[k][1:])), 0)))
    return order


def fired(rule: Rule, facts: DataFrame, delta: DataFrame) -> DataFrame:
    """(pred, args, premises) of every use of the rule with a premise in delta. The new premise comes first, so what is joined stays small. Only a rule whose body falls into parts without a common variable asks for their product."""
    out = None
    for new in range(len(rule.body)):
        joined = None
        for k in connected(rule.body, new):
            rows = matched(delta if k == new else facts, rule.body[k], k)
            shared = [] if joined is None else [c for c in rows.columns if c in joined.columns]
            joined = rows if joined is None else joined.join(rows, shared) if shared else joined.join(rows)
        args = F.array(*[F.col(t) if variable(t) else F.lit(t) for t in rule.head[1:]])
        use = joined.select(F.lit(rule.head[0]).alias("pred"), args.alias("args"), F.array(*[f"premise_{k}" for k in range(len(rule.body))]).alias("premises"))
        out = use if out is None else out.unionByName(use)
    return out


def chained(facts: DataFrame, rules: list[Rule], justify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(beliefs with their depth, justifications). Depth 0 is given; a derived fact's is the round that first gave it: 1 more than the deepest premise of its shallowest proof. Without `justify` no justifications are kept."""
    base = written(facts.select("pred", "args").where("pred is not null and args is not null").distinct().withColumn("depth", F.lit(0).cast("long")), "beliefs")
    beliefs, delta, uses, depth = base, base, None, 0
    while True:
        depth += 1
        step = None
        for number, rule in enumerate(rules):
            use = fired(rule, beliefs, delta).withColumn("rule", F.lit(number))
            step = use if step is None else step.unionByName(use)
        if step is None:
            break
        if justify:
            step = written(step.distinct(), "uses")
            uses = step if uses is None else uses.unionByName(step)
        delta = written(step.select("pred", "args").distinct().join(beliefs, ["pred", "args"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "beliefs")
        if delta.isEmpty():
            break
        beliefs = beliefs.unionByName(delta)
        if depth % COMPACT == 0:  # else every round would read one more table
            beliefs = written(beliefs, "beliefs")
            uses = written(uses, "uses") if uses is not None else None
    if uses is None:
        uses = facts.sparkSession.createDataFrame([], f"{SCHEMA}, premises array<struct<pred: string, args: array<string>>>, rule int")
    return beliefs, uses.distinct()


def retracted(facts: DataFrame, rules: list[Rule], gone: DataFrame) -> DataFrame:
    """The beliefs (pred, args) lost with the facts `gone`: what chained before and does not without them."""
    before, _ = chained(facts, rules, justify=False)
    after, _ = chained(facts.join(gone.select("pred", "args"), ["pred", "args"], "left_anti"), rules, justify=False)
    return before.select("pred", "args").join(after, ["pred", "args"], "left_anti")


def contradictions(beliefs: DataFrame) -> DataFrame:
    """(pred, args) believed together with ("not", pred, *args)."""
    negated = beliefs.where("pred = 'not' and size(args) > 0").select(F.col("args")[0].alias("pred"), F.expr("slice(args, 2, greatest(size(args) - 1, 0))").alias("args"))
    return beliefs.select("pred", "args").join(negated.distinct(), ["pred", "args"], "left_semi")


def proofs(beliefs: DataFrame, uses: DataFrame) -> DataFrame:
    """(pred, args, depth, rule, premises): for each derived fact the use with the shallowest premises, the least of equal ones. Following premises ends at given facts."""
    at = beliefs.select(F.struct("pred", "args").alias("premise"), F.col("depth").alias("premise_depth"))
    each = uses.select("pred", "args", "rule", "premises", F.explode("premises").alias("premise")).join(at, "premise")
    deepest = each.groupBy("pred", "args", "rule", "premises").agg(F.max("premise_depth").alias("deepest"))
    best = deepest.groupBy("pred", "args").agg(F.min(F.struct("deepest", "rule", "premises")).alias("b")).select("pred", "args", "b.rule", "b.premises")
    return beliefs.where("depth > 0").join(best, ["pred", "args"])


def sound(steps: DataFrame, facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(pred, args, holds): independent check of proof steps: all premises are given or proved, and the rule, fired on just these premises, gives the fact."""
    known = facts.select("pred", "args").unionByName(steps.select("pred", "args")).distinct()
    premises = steps.select("pred", "args", F.explode("premises").alias("p"))
    missing = premises.join(known.select(F.struct("pred", "args").alias("p")), "p", "left_anti").select("pred", "args").distinct().withColumn("missing", F.lit(True))
    again = None
    for number, rule in enumerate(rules):
        use = fired(rule, known, known).withColumn("rule", F.lit(number))
        again = use if again is None else again.unionByName(use)
    ok = steps.join(again.distinct(), ["pred", "args", "rule", "premises"], "left_semi").select("pred", "args").withColumn("fires", F.lit(True)).distinct()
    out = steps.select("pred", "args").join(missing, ["pred", "args"], "left").join(ok, ["pred", "args"], "left")
    return out.select("pred", "args", (F.col("missing").isNull() & F.col("fires").isNotNull()).alias("holds"))


def proved(goals: DataFrame, facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(pred, args, proved): goals decided by chaining only with the rules their predicates depend on."""
    wanted, reach = {r.pred for r in goals.select("pred").distinct().collect()}, set()
    while wanted - reach:
        reach |= wanted
        wanted = {a[0] for rule in rules if rule.head[0] in reach for a in rule.body} | reach
    needed = [rule for rule in rules if rule.head[0] in reach]
    beliefs, _ = chained(facts.where(F.col("pred").isin(sorted(reach))), needed, justify=False)
    return goals.select("pred", "args").distinct().join(beliefs.select("pred", "args").withColumn("proved", F.lit(True)), ["pred", "args"], "left").fillna(False, ["proved"])
