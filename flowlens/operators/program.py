"""From a program's facts to its call edges: constraints, points-to sets, indirect calls fed back, and the cascade of lookups.

The facts are those of `sources.facts.functions`, one row for each definition. Names are program-wide; definitions of one name
are told apart by their place in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import text as T
from flowlens.operators import cfg, constraints, resolve
from flowlens.operators.loops import returning_functions, staged
from flowlens.operators.pointsto import Solver, resolve_calls
from flowlens.sources import facts


class Program:
    """The relations of a program, each written once."""

    def __init__(self, fns: DataFrame):
        """fns: fn, def_pos, f."""
        fns = staged(fns)
        self.sites = staged(facts.call_sites(fns))
        told = fns.select("fn", "def_pos", F.posexplode("f.attributes.pointerAssignments").alias("pos", "a"))
        self.assignments = staged(told.select(
            "fn", "def_pos", F.col("pos").cast("long").alias("pos"), F.col("a.lhsExpression").alias("lhs"), F.col("a.rhsExpression").alias("rhs"), F.col("a.assignedFunction").alias("assigned"),
            F.col("a.rhsTakesFunctionAddress").alias("takes_address"), F.col("a.lhsIsGlobal").alias("lhs_global")))
        block = fns.select("fn", "def_pos", F.explode("f.blocks").alias("b"))
        self.lines = staged(block.select("fn", "def_pos", F.col("b.id").alias("block"), F.posexplode("b.lines").alias("line_pos", "text")))
        called = block.select("fn", F.col("b.id").alias("block"), F.posexplode("b.lineCallSiteIds").alias("line_pos", "ids"))
        self.line_calls = called.select("fn", "block", "line_pos", F.explode("ids").alias("site"))
        self.functions = staged(fns.select(F.col("fn").alias("name")).distinct())
        self.params = staged(fns.select("fn", F.posexplode("f.attributes.parameterNames").alias("pos", "name")).select("fn", F.col("pos").cast("long").alias("pos"), "name").distinct())
        self.arity = staged(fns.select(F.col("fn").alias("name"), F.size("f.attributes.parameterNames").alias("n")).groupBy("name").agg(F.min(F.when(F.col("n") >= 0, F.col("n"))).alias("n_params")))
        self.returns = staged(self.lines.select("fn", F.col("line_pos").cast("long").alias("pos"), F.col("text").alias("line"), T.returned_expression(F.col("text")).alias("rhs")).where("rhs <> ''"))
        giving = fns.where("f.attributes.returnsPointerLike").select("fn")
        calls = self.returns.select("fn", T.callee_name(F.col("rhs")).alias("callee")).where("callee <> ''")
        self.returning = staged(returning_functions(giving, calls).select(F.col("fn").alias("name")))
        self.globals = staged(constraints.global_slots(self.assignments))
        texts = self.assignments.select(F.col("rhs").alias("text")).unionByName(self.sites.select(F.explode("args").alias("text")))
        self.taken = staged(constraints.taken_slots(texts))
        self.linear = cfg.linear_functions(facts.blocks(fns))
        self.mappings = staged(facts.member_mappings(fns).select("fn", "pos", F.col("structVariable").alias("variable"), F.col("memberName").alias("member"), F.col("functionName").alias("function")))

    def slots(self) -> DataFrame:
        """fn, slot of every access in assignments and arguments."""
        texts = self.assignments.select("fn", F.explode(F.array("lhs", "rhs")).alias("text")).unionByName(self.sites.select("fn", F.explode("args").alias("text")))
        return texts.select("fn", T.main_slot(F.col("text")).alias("slot")).where("slot <> ''").distinct()

    def arguments(self, calls: DataFrame) -> DataFrame:
        """calls: site, target. The constraints of their arguments."""
        told = self.sites.join(calls.select("site", F.col("target").alias("callee")), "site").select("fn", "site", "callee", "args")
        return constraints.argument_constraints(told, self.params, self.functions, self.globals, self.taken)

    def constraints(self) -> DataFrame:
        """All constraints but those of indirect calls, in the form of `operators.constraints`."""
        param_names = self.params.select("fn", "name")
        told = constraints.assignment_constraints(self.assignments, self.functions, self.returning, self.globals, param_names, self.taken)
        returned = self.returns.join(self.returning.withColumnRenamed("name", "fn"), "fn", "left_semi")
        parts = [
            constraints.strong_updates(told, self.linear, param_names), constraints.return_constraints(returned, self.functions, self.globals, param_names, self.returning, self.taken),
            constraints.member_constraints(self.mappings, self.functions, self.globals), constraints.field_collapse(self.slots(), self.globals),
            constraints.transfer_constraints(self.lines.select("fn", F.col("line_pos").cast("long").alias("pos"), F.col("text").alias("line")), self.globals, param_names),
            self.arguments(self.sites.where("direct <> ''").select("site", F.col("direct").alias("target"))),
        ]
        return reduce(DataFrame.unionByName, [p.select("rule", "kind", "a", "b", "fn", "pos", "strong") for p in parts])

    def indirect(self) -> DataFrame:
        """The rows of sites that are no direct call."""
        return self.sites.where("coalesce(direct, '') = ''")

    def probes(self) -> DataFrame:
        """site, probe, n_args of indirect calls: the nodes of what they call through, with open indices and roots."""
        slot = self.indirect().select("site", "fn", F.size("args").alias("n_args"), F.explode(F.array("through", "callee_expression")).alias("text")).select("site", "fn", "n_args", T.main_slot(F.col("text")).alias("slot"))
        slot = slot.where("slot <> ''").select("site", "fn", "n_args", F.explode(T.slot_aliases(F.col("slot"))).alias("slot")).where("slot <> ''").distinct()
        nodes = constraints.nodes_of(slot, "slot", self.globals, self.params.select("fn", "name"), self.taken)
        return nodes.select("site", F.col("node").alias("probe"), F.greatest("n_args", F.lit(0)).alias("n_args")).distinct()

    def receivers(self) -> DataFrame:
        """site, node of what takes a call's return on its line."""
        slot = resolve.receivers(self.line_calls, self.lines).join(self.sites.select("site", "fn").distinct(), "site")
        return constraints.nodes_of(slot, "slot", self.globals, self.params.select("fn", "name"), self.taken).select("site", "node").distinct()

    def resolved(self, prune: bool = True, max_rounds: int = 8) -> DataFrame:
        """site, target of indirect calls by points-to sets, fed back. prune: solve only what a call can depend on; the calls are the same."""
        probes = staged(self.probes())
        solver = Solver(probes.sparkSession, probes.select(F.col("probe").alias("node")).distinct() if prune else None).add(**constraints.split(staged(self.constraints())))
        receivers, returning = staged(self.receivers()), self.returning.withColumnRenamed("name", "fn")
        fn = F.expr("substring(target, 4)")

        def fed_back(calls: DataFrame) -> dict[str, DataFrame]:
            calls = staged(calls.select("site", fn.alias("target")))
            told = constraints.split(staged(self.arguments(calls)))
            given = calls.join(returning.withColumnRenamed("fn", "target"), "target", "left_semi").join(receivers, "site").select(F.concat(F.lit("ret::"), "target").alias("src"), F.col("node").alias("dst"))
            return told | {"copy": told["copy"].unionByName(given)}

        functions = self.arity.select(F.concat(F.lit("fn:"), "name").alias("name"), "n_params")
        return resolve_calls(solver, probes, functions, fed_back, max_rounds=max_rounds).select("site", fn.alias("target"))

    def call_edges(self, prune: bool = True) -> DataFrame:
        """site, caller, callee, step, kind of every call; indirect ones that no lookup settles have the unknown callee."""
        row = self.sites.select("site", "fn", F.nullif("direct", F.lit("")).alias("direct"), T.normalize_indirect(F.col("callee_expression")).alias("expr"), F.size("args").alias("n_args"))
        slots = self.assignments.select("fn", "pos", T.main_slot(F.col("lhs")).alias("lhs"), T.main_slot(F.col("rhs")).alias("rhs"), F.col("rhs").alias("text"))
        named = slots.select("fn", F.col("lhs").alias("slot"), F.explode(T.identifiers(F.col("text"))).alias("target")).join(self.functions.withColumnRenamed("name", "target"), "target", "left_semi").where("slot <> ''").distinct()
        moved = self.lines.select("fn", T.memory_transfer(F.col("text")).alias("m")).where("m.source is not null").select("fn", T.main_slot(F.col("m.target")).alias("base"), T.main_slot(F.col("m.source")).alias("source")).distinct()
        scoped = resolve.copied_targets(named.select("fn", "slot", "target"), moved.select("fn", "source", F.col("base").alias("target_slot")))
        everywhere = scoped.join(self.globals, "slot", "left_semi").select(F.lit(None).cast("string").alias("fn"), "slot", "target").distinct()
        entries = resolve.member_entries(self.assignments, self.functions)
        mapped = self.mappings.select(F.concat_ws(".", "variable", "member").alias("path"), F.col("function").alias("target")).join(self.functions.withColumnRenamed("name", "target"), "target", "left_semi")
        entries = entries.unionByName(mapped.select("path", "target")).distinct()
        aliases = resolve.last_assigned(slots.select("fn", "pos", "lhs", "rhs").where("lhs <> '' and rhs <> ''"))
        found = resolve.cascade(row, self.resolved(prune), entries, aliases, moved, self.globals, scoped.select("fn", "slot", "target").unionByName(everywhere))
        return resolve.fitting(found, row, self.arity).join(row.select("site", F.col("fn").alias("caller")), "site").select("site", "caller", F.col("target").alias("callee"), "step", "kind")
