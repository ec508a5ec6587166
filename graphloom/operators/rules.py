"""Rules over facts (pred, a, b): Horn clauses by fixpoint, and policies as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved

_ATOM = re.compile(r"\s*([a-z_]\w*)\s*\(([^)]*)\)\s*")


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


def atom(text: str) -> Atom:
    m = _ATOM.fullmatch(text)
    if not m:
        raise ValueError(f"not an atom: {text!r}")
    return Atom(m[1], tuple(a.strip() for a in m[2].split(",")))


def parsed(text: str) -> Rule:
    """'head(X, Y) :- body(X, Z), body(Z, Y).' or 'IF body(X) AND body(X, Y) THEN head(X)'."""
    if m := re.fullmatch(r"\s*IF\s+(.*?)\s+THEN\s+(.*?)\s*", text):
        return Rule(atom(m[2]), tuple(atom(x) for x in re.split(r"\s+AND\s+", m[1])))
    head, _, body = text.strip().rstrip(".").partition(":-")
    parts = re.findall(r"[a-z_]\w*\s*\([^)]*\)", body)
    if not parts:
        raise ValueError(f"a rule needs a body: {text!r}")
    return Rule(atom(head), tuple(atom(p) for p in parts))


def is_variable(term: str) -> bool:
    return term[:1].isupper() or term[:1] == "?"


def _bound(facts: DataFrame, a: Atom, *kept: str) -> DataFrame:
    """Rows that fit an atom, a column for each of its variables; or the columns `kept`."""
    rows = facts.where((F.col("pred") == a.pred) & (F.size("args") == len(a.args)))
    names: dict[str, Column] = {}
    for k, term in enumerate(a.args):
        value = F.col("args")[k]
        if not is_variable(term):
            rows = rows.where(value == term)
        elif term in names:
            rows = rows.where(value == names[term])
        else:
            names[term] = value
    if kept:
        return rows.select(*kept)
    return rows.select(*[v.alias(n) for n, v in names.items()]) if names else rows.select(F.lit(1).alias("_hit")).limit(1)


#: Bindings of a body atom that may be combined with all others, where the rest of the body
#: shares no variable with it.
FREE_ROWS = 10_000


def fired(rule: Rule, facts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Heads of the rule with at least one body atom met by a fresh fact."""
    out = None
    for new in range(len(rule.body)):
        head = _heads(rule, facts, fresh, new)
        out = head if out is None else out.union(head)
    return out.distinct()


def _heads(rule: Rule, facts: DataFrame, fresh: DataFrame, new: int = 0) -> DataFrame:
    """Heads of the rule with body atom number `new` met by a fresh fact, the others by any."""
    rows = _bound(fresh, rule.body[new])
    rest = [a for k, a in enumerate(rule.body) if k != new]
    while rest:
        # atoms that share a variable with what is bound go first
        a = next((x for x in rest if set(x.args) & set(rows.columns)), rest[0])
        rest.remove(a)
        other = _bound(facts, a)
        shared = [c for c in rows.columns if c in other.columns]
        rows = rows.join(other, shared) if shared else _combined(rows, other, rule)
    return rows.select(F.lit(rule.head.pred).alias("pred"), F.array(*[F.col(t) if is_variable(t) else F.lit(t) for t in rule.head.args]).alias("args"))


def _combined(rows: DataFrame, other: DataFrame, rule: Rule) -> DataFrame:
    """Every row with every other: only where the others are few."""
    other = other.distinct()
    if other.limit(FREE_ROWS + 1).count() > FREE_ROWS:
        raise ValueError(f"an atom that shares no variable with the others has over {FREE_ROWS} bindings: {rule}")
    return rows.join(F.broadcast(other))


def derived(facts: DataFrame, rules: list[Rule | str], *, rounds: int | None = None) -> DataFrame:
    """All facts (pred, args) that follow: semi-naive, each round joins only what is new."""
    rules = [parsed(r) if isinstance(r, str) else r for r in rules]
    saved = Saved(facts.sparkSession, "rules")
    known = saved.save(facts.select("pred", "args").distinct())
    fresh = known
    k = 0
    while rounds is None or k < rounds:
        k += 1
        heads = None
        for rule in rules:
            got = fired(rule, known, fresh)
            heads = got if heads is None else heads.union(got)
        fresh = saved.save(heads.distinct().join(known, ["pred", "args"], "left_anti"))
        if fresh.isEmpty():
            break
        known = saved.save(known.union(fresh))
    return known


_OWN, _KNOWN = "own ", "known "
_WHO = "?argument"


def arguments(premises: DataFrame, claims: DataFrame, rules: list[Rule | str], *, known: DataFrame) -> DataFrame:
    """argument, valid, unknown_premises, conclusions: whether each argument's claims (argument,
    pred, args) all follow from its premises (the same columns) and what is known (pred, args) by
    one pass over the rules in their order, each of which sees what the earlier ones gave; how
    many premises are not known; how many new facts it took a premise of its own to conclude.

    All arguments are checked at once: an argument's facts carry its name as their first term,
    which the joins of a rule's body then share, and a body atom is met by an own or by a known
    fact. So known facts are not copied to the arguments, and no argument sees another's.

    Defined cases: a claim that is known or a premise does not follow, as nothing new is
    concluded; an argument without a claim is not valid; one without premises may be valid by
    what is known; repeated rows count once."""
    rules = [parsed(r) if isinstance(r, str) else r for r in rules]
    saved = Saved(premises.sparkSession, "arguments")
    said = saved.save(premises.select(F.col("argument").cast("string").alias("argument"), "pred", "args").distinct())
    base = saved.save(known.select("pred", "args").distinct())

    def tagged(kind: str, rows: DataFrame, args: Column) -> DataFrame:
        return rows.select(F.concat(F.lit(kind), "pred").alias("pred"), args.alias("args"))

    facts = saved.save(tagged(_OWN, said, F.concat(F.array("argument"), "args")).union(tagged(_KNOWN, base, F.col("args"))))
    new = None
    for rule in rules:
        heads = None
        for kinds in product((_OWN, _KNOWN), repeat=len(rule.body)):
            own = _OWN in kinds
            body = tuple(Atom(k + a.pred, ((_WHO,) if k == _OWN else ()) + a.args) for k, a in zip(kinds, rule.body, strict=True))
            head = Atom((_OWN if own else _KNOWN) + rule.head.pred, ((_WHO,) if own else ()) + rule.head.args)
            got = _heads(Rule(head, body), facts, facts, kinds.index(_OWN) if own else 0)
            heads = got if heads is None else heads.union(got)
        heads = saved.save(heads.distinct().join(facts, ["pred", "args"], "left_anti"))
        # what is known, or follows from that alone, is not an argument's own conclusion
        all_known = facts.union(heads).where(F.startswith("pred", F.lit(_KNOWN))).select(F.concat(F.lit(_OWN), F.substring("pred", len(_KNOWN) + 1, 1 << 30)).alias("pred"), F.col("args").alias("_rest"))
        own_heads = heads.where(F.startswith("pred", F.lit(_OWN))).withColumn("_rest", F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0))))
        fresh = heads.where(F.startswith("pred", F.lit(_KNOWN))).union(own_heads.join(all_known, ["pred", "_rest"], "left_anti").select("pred", "args"))
        fresh = saved.save(fresh)
        facts = saved.save(facts.union(fresh))
        new = fresh if new is None else new.union(fresh)

    own = new.where(F.startswith("pred", F.lit(_OWN))).select(F.col("args")[0].alias("argument"), F.substring("pred", len(_OWN) + 1, 1 << 30).alias("pred"), F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0))).alias("args"))
    general = new.where(F.startswith("pred", F.lit(_KNOWN))).select(F.substring("pred", len(_KNOWN) + 1, 1 << 30).alias("pred"), "args")
    asked = claims.select(F.col("argument").cast("string").alias("argument"), "pred", "args").distinct()
    met = asked.join(own.withColumn("_own", F.lit(True)), ["argument", "pred", "args"], "left").join(general.withColumn("_general", F.lit(True)), ["pred", "args"], "left")
    # a premise is no conclusion, even if it follows from what is known
    met = met.join(said.withColumn("_said", F.lit(True)), ["argument", "pred", "args"], "left")
    verdict = met.groupBy("argument").agg(F.every(((F.col("_own") | F.col("_general")).isNotNull()) & F.col("_said").isNull()).alias("valid"))
    unknown = said.join(base, ["pred", "args"], "left_anti").groupBy("argument").agg(F.count("*").alias("unknown_premises"))
    n = own.groupBy("argument").agg(F.count("*").alias("conclusions"))
    names = said.select("argument").union(asked.select("argument")).distinct()
    out = names.join(verdict, "argument", "left").join(unknown, "argument", "left").join(n, "argument", "left")
    return out.select("argument", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("unknown_premises", F.lit(0)).alias("unknown_premises"), F.coalesce("conclusions", F.lit(0)).alias("conclusions"))


def proofs(facts: DataFrame, rules: list[Rule | str], goal: str, *, max_depth: int = 10) -> DataFrame:
    """(pred, args, depth, rule): facts that match the goal and can be proved with rules nested
    at most max_depth deep: the least depth (0 for a given fact) and the first rule that proves
    it there. Only predicates that the goal depends on are derived."""
    rules = [parsed(r) if isinstance(r, str) else r for r in rules]
    wanted, size = {atom(goal).pred}, 0
    while size != len(wanted):
        size = len(wanted)
        wanted |= {a.pred for r in rules if r.head.pred in wanted for a in r.body}
    rules = [r for r in rules if r.head.pred in wanted]
    saved = Saved(facts.sparkSession, "proofs")
    given = facts.where(F.col("pred").isin(*wanted)).select("pred", "args").distinct()
    fresh = saved.save(given.select("pred", "args", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("rule")))
    for depth in range(1, max_depth + 1):
        known = saved.all().select("pred", "args")
        heads = None
        for k, rule in enumerate(rules):
            got = fired(rule, known, fresh.select("pred", "args")).withColumn("rule", F.lit(k))
            heads = got if heads is None else heads.union(got)
        if heads is None:
            break
        heads = heads.groupBy("pred", "args").agg(F.min("rule").alias("rule")).join(known, ["pred", "args"], "left_anti")
        fresh, (n, _) = saved.signed(heads.select("pred", "args", F.lit(depth).alias("depth"), "rule"), "pred", "args")
        if not n:
            break
    fits = _bound(saved.all().select("pred", "args", "depth", "rule"), atom(goal), "pred", "args", "depth", "rule")
    return fits.select("pred", "args", "depth", "rule")


def explained(rules: list[str]) -> Column:
    """A proof as text, over the columns of `proofs`."""
    fact = F.format_string("%s(%s)", "pred", F.array_join("args", ", "))
    texts = F.array(*[F.lit(r) for r in rules])
    return F.when(F.col("rule").isNull(), F.concat(fact, F.lit(" is given"))).otherwise(F.concat(fact, F.lit(" follows at depth "), F.col("depth").cast("string"), F.lit(" by "), F.get(texts, F.col("rule"))))


def hypotheses(observations: DataFrame, rules: list[Rule | str], confidence: list[float]) -> DataFrame:
    """(pred, args, rule, score, rank): rules that could explain an observation (pred, args), as
    their heads unify with it. The score is 0.4 of the rule's confidence, 0.3 of a coverage of
    0.5, and 0.3 of its simplicity, 1 / (1 + conditions)."""
    rules = [parsed(r) if isinstance(r, str) else r for r in rules]
    found = None
    for k, (rule, sure) in enumerate(zip(rules, confidence, strict=True)):
        score = 0.4 * sure + 0.3 * 0.5 + 0.3 / (1 + len(rule.body))
        got = _bound(observations, rule.head, "pred", "args").select("pred", "args", F.lit(k).alias("rule"), F.lit(score).alias("score"))
        found = got if found is None else found.union(got)
    order = Window.partitionBy("pred", "args").orderBy(F.desc("score"), "rule")
    return found.distinct().withColumn("rank", F.row_number().over(order))


def answers(facts: DataFrame, goal: str) -> DataFrame:
    """Bindings of the goal's variables; for a ground goal one row if it holds."""
    return _bound(facts, atom(goal)).distinct()


def violations(*checks: tuple[str, Column]) -> Column:
    """Array of the names of the conditions that do not hold (null counts as not holding)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def policy(rules: dict, columns: dict[str, Column]) -> Column:
    """min_X, max_X, required_X, allowed_X rules; a field that is missing fails."""
    checks = []
    for name, want in rules.items():
        kind, _, field = name.partition("_")
        c = columns.get(field, F.lit(None))
        ok = {"min": lambda: c >= want, "max": lambda: c <= want, "required": lambda: c.isNotNull(), "allowed": lambda: c.isin(want)}[kind]()
        checks.append((name, ok))
    return violations(*checks)


#: Roles that may approve any amount, and the amount above which they must.
DIRECTORS = ("role:Director", "role:VP", "role:CFO")
LARGE_AMOUNT = 25000


def duty_conflicts(orders: DataFrame, roles: DataFrame, related: DataFrame) -> DataFrame:
    """(po, rule, evidence): separation of duties broken by a purchase order.

    orders: po, requested_by, approved_by, paid_by, vendor, amount; roles: employee, role;
    related: vendor, employee. SOD-01 approver pays, SOD-02 approver requests, SOD-03 a large
    amount approved below director level, SOD-04 the vendor is related to the approver."""
    rows = orders.join(roles.select(F.col("employee").alias("approved_by"), "role"), "approved_by", "left").join(related.select("vendor", F.col("employee").alias("relative")), "vendor", "left")
    by = F.col("approved_by")

    def broken(rule: str, when: Column, *evidence: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.concat(*evidence).alias("evidence")))

    found = F.array(
        broken("SOD-01", by == F.col("paid_by"), F.lit("approved and paid by "), by),
        broken("SOD-02", by == F.col("requested_by"), F.lit("requested and approved by "), by),
        broken("SOD-03", (F.col("amount") > LARGE_AMOUNT) & ~F.col("role").isin(*DIRECTORS), F.lit("approved by "), by, F.lit(", "), F.col("role")),
        broken("SOD-04", by == F.col("relative"), F.col("vendor"), F.lit(" is related to "), by),
    )
    return rows.select("po", F.explode(F.array_compact(found)).alias("v")).select("po", "v.rule", "v.evidence").distinct()
