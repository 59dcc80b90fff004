import json
from pathlib import Path

import pytest
from helpers import GOLDEN, close, table

from morphotab.operators import declared
from morphotab.operators.derive import derive

TEXT = (Path(declared.__file__).parent / "variables.json").read_text()
KEY = ["Image File", "Object", "Channel", "Object ID"]


def rows(df):
    return {tuple(r[k] for k in KEY): r.asDict() for r in df.collect()}


def test_the_declared_catalogue_equals_the_built_in_one(spark, tmp_path):
    (tmp_path / "v.json").write_text(TEXT)
    variables = declared.read_variables(spark, str(tmp_path / "v.json"))
    base = table(spark, [*GOLDEN, ("A", "Surface", "CC", "1", "3", None, 1.0, 2.0, None, 0.0, 4.0)])
    built_in = derive(base)
    found = rows(declared.derive_declared(derive(base, []).drop(*[v.name for v in variables]), variables))
    for key, r in rows(built_in).items():
        for v in variables:
            assert close(found[key][v.name], r[v.name]), (key, v.name)
    assert len(variables) == 16 and set(found) == set(rows(built_in))


def test_a_new_variable_needs_no_code(spark):
    own = {
        "variables": [
            {"name": "Crowding", "value": {"of": "Area share", "as": "total"}, "by": {"of": "Volume"}},
            {"name": "Area share", "value": {"of": "Area"}, "by": {"of": "Area", "as": "label"}},
            {"name": "Twice", "value": {"of": "Area share"}, "by": {"of": "Area share"}},
            {"name": "Channels", "value": {"of": "Intensity Sum", "as": "channel", "channel": "1"}, "by": {"of": "Intensity Sum", "as": "channel", "channel": "2"}},
            {"name": "Nowhere", "value": {"of": "Missing column"}},
            {"name": "Beyond", "value": {"of": "Nowhere", "as": "total"}},
        ]
    }
    out = declared.derive_declared(table(spark, GOLDEN), declared.parse_variables(json.dumps(own)))
    got = rows(out)[("A", "CC", "1", "1")]
    assert close(got["Area share"], 10 / 25) and close(got["Crowding"], 1 / 5) and close(got["Twice"], 1.0) and close(got["Channels"], 2.0)
    assert "Nowhere" not in out.columns and "Beyond" not in out.columns
    only = declared.derive_declared(table(spark, GOLDEN), declared.parse_variables(json.dumps(own)), ["Crowding"])
    assert only.columns[-2:] == ["Area share", "Crowding"] and "Twice" not in only.columns


def test_wrong_declarations_are_named():
    circle = {"variables": [{"name": a, "value": {"of": b}} for a, b in (("A", "B"), ("B", "C"), ("C", "B"))]}
    with pytest.raises(ValueError, match="B -> C -> B"):
        declared.in_order(declared.parse_variables(json.dumps(circle)), ["A"])
    with pytest.raises(ValueError, match="twice"):
        declared.parse_variables(json.dumps({"variables": [{"name": "A", "value": {"of": "x"}}] * 2}))
    with pytest.raises(ValueError, match="kinds"):
        declared.parse_variables(json.dumps({"variables": [{"name": "A", "value": {"of": "x", "as": "median"}}]}))
    assert [v.name for v in declared.parse_variables(TEXT, None)][:2] == ["Group Volume", "Group Surface Area"]
    with pytest.raises(ValueError, match="not declared"):
        declared.in_order([], ["A"])
