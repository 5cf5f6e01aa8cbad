import pytest

from docweave.operators import workflow_models as m
from docweave.operators.workflow import GraphError


def test_answers():
    cats = [{"id": "a", "label": "Alpha"}, {"id": "b", "label": "Beta"}]
    assert m.category_of('ok {"category": "b"}', cats) == "b" and m.category_of('{"category": "alpha"}', cats) == "a" and m.category_of("none", cats) is None
    assert m.fields_of('{"n": "1,200", "x": 1.5, "t": [1], "s": 3}', [{"id": "n", "type": "number"}, {"id": "x", "type": "number"}, {"id": "z", "type": "number"}, {"id": "t"}, {"id": "s"}]) == {"n": 1200, "x": 1.5, "z": None, "t": "[1]", "s": "3"}
    with pytest.raises(GraphError):
        m.fields_of("no", [])


def test_plan_falls_back():
    good = '{"nodes": [{"id": "i", "kind": "input"}, {"id": "o", "kind": "answer"}], "edges": [{"from": "i", "to": "o"}]}'
    assert m.plan(lambda q: good, "q", set()).order() == ["i", "o"]
    assert m.plan(lambda q: "{", "q", set()) is None and m.plan(lambda q: 1 / 0, "q", set()) is None


def test_nesting_approval_budget():
    assert m.nested_cycle("a", {"a": {"b"}, "b": {"c"}, "c": {"a"}}) and not m.nested_cycle("a", {"a": {"b"}, "b": {"b"}})
    now = [0.0]
    store = m.Approvals(10, lambda: now[0])
    token = store.store("u", {"x": 1})
    assert store.consume("other", token) is None and store.consume("u", token) == {"x": 1} and store.consume("u", token) is None
    late = store.store("u", 1)
    now[0] = 11.0
    assert store.consume("u", late) is None
    ctx = m.ToolContext(2)
    ctx.spend(), ctx.nested().spend()
    with pytest.raises(GraphError):
        ctx.spend()
    with pytest.raises(GraphError):
        m.ToolContext(2, depth=4).spend()


def test_a_reference_is_the_whole_value():
    from docweave.operators.workflow import GraphError, parse_reference, references_in, resolve

    assert parse_reference(" {{ a.b }} ") == ["a", "b"] and parse_reference("plain {a}") is None and parse_reference(3) is None
    for mixed in ("a {{x}}", "{{x}} {{y}}", "{{x", "x}}", "{{ 1+1 }}"):
        with pytest.raises(GraphError):
            parse_reference(mixed)
    with pytest.raises(GraphError):
        references_in({"k": ["{{x}}", "see {{x}}"]})
    with pytest.raises(GraphError):
        resolve({"k": "see {{x}}"}, {"x": 1})
    assert resolve({"k": "{{x}}"}, {"x": 1}) == {"k": 1}
