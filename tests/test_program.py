"""Whole documents: facts as a front end writes them, to call edges."""

import json

from flowlens.operators.program import Program
from flowlens.sources import facts


def call(site, expr, *args, direct=None):
    return {"callSiteId": site, "calleeExpression": expr, "directCallee": direct, "throughIdentifier": "" if direct else expr, "argumentExpressions": list(args), "isIndirect": not direct}


def assign(lhs, rhs, function=None, address=False, is_global=False):
    return {"lhsExpression": lhs, "rhsExpression": rhs, "assignedFunction": function, "rhsTakesFunctionAddress": address, "lhsIsGlobal": is_global}


def function(name, params=(), assigns=(), calls=(), lines=(), mappings=(), gives=False):
    """lines: (text, sites). One block."""
    attributes = {
        "parameterNames": list(params), "pointerAssignments": list(assigns), "callSites": list(calls), "structMemberMappings": [dict(zip(("structVariable", "memberName", "functionName"), m)) for m in mappings], "returnsPointerLike": gives}
    block = {"id": 0, "lines": [t for t, _ in lines], "lineCallSiteIds": [list(s) for _, s in lines], "successors": []}
    return {"name": name, "entryBlockId": 0, "exitBlockId": 0, "attributes": attributes, "blocks": [block]}


#: Timers whose handlers are kept in a union, and called through an indexed copy of it.
TIMERS = [
    function("StartTimer", ["x", "y", "handlerFunction"], [assign("insert", "&gSWTimers[0].timerList[y]"), assign("insert->timerVal", "x"), assign("insert->fp", "handlerFunction"), assign("insert->next", "NULL")]),
    function("TimerIntHandler", [], [assign("current", "gSWTimers[0].head"), assign("fps[0]", "current->fp"), assign("fps[1]", "current->fp"), assign("gSWTimers[0].head", "current->next", is_global=True)],
             [call("t1", "fps[0].handlerFunc1", "0"), call("t2", "fps[1].handlerFunc2")], [("fps[0].handlerFunc1(0);", ["t1"]), ("fps[1].handlerFunc2();", ["t2"])]),
    function("handlerFunc1", ["portId"]), function("handlerFunc2"),
    function("main", [], [assign("fps.handlerFunc1", "handlerFunc1", "handlerFunc1"), assign("fps.handlerFunc2", "handlerFunc2", "handlerFunc2")],
             [call("m1", "StartTimer", "10", "0", "fps", direct="StartTimer"), call("m2", "TimerIntHandler", direct="TimerIntHandler")]),
]
#: A function given as an argument is called by its receiver, returns another one, and that is called in turn.
CALLBACKS = [
    function("run", ["cb"], [], [call("r1", "cb", "7"), call("r2", "next")], [("next = cb(7);", ["r1"]), ("next();", ["r2"])]),
    function("pick", ["n"], lines=[("return last;", [])], gives=True), function("last", []), function("unused", ["a", "b"]),
    function("start", ["go"], [assign("x", "go"), assign("p", "&x"), assign("y", "*p")], [call("s1", "run", "(fn_t)y", direct="run"), call("s2", "run", "unused", direct="run")]),
    function("main", [], [assign("slot", "pick", "pick")], [call("m1", "start", "slot", direct="start"), call("m2", "nowhere")]),
    function("after", [], [], [call("a1", "next")]),
]


def program(spark, tmp_path, functions):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"version": 1, "functions": functions}))
    return Program(facts.functions(spark, str(path)))


def test_handlers_in_a_union_are_found_by_their_member(spark, tmp_path):
    found = {(r["site"], r["caller"], r["callee"], r["kind"]) for r in program(spark, tmp_path, TIMERS).call_edges().collect()}
    assert found == {
        ("m1", "main", "StartTimer", "direct"), ("m2", "main", "TimerIntHandler", "direct"), ("t1", "TimerIntHandler", "handlerFunc1", "indirect"), ("t2", "TimerIntHandler", "handlerFunc2", "indirect")}


def test_what_calls_return_is_called_in_turn(spark, tmp_path):
    told = program(spark, tmp_path, CALLBACKS)
    # unused takes two arguments where cb is given one; next holds what pick returns once cb is known to be pick
    assert {tuple(r) for r in told.resolved().collect()} == {("r1", "pick"), ("r2", "last")}
