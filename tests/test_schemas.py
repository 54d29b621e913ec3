from __future__ import annotations

from collections import Counter

from continuity.schemas import flight_schema


def test_flight_schema():
    schema = flight_schema()
    assert len(schema) == 31
    assert all(field.nullable for field in schema)
    kinds = Counter(field.dataType.simpleString() for field in schema)
    assert kinds == {"int": 10, "string": 21}
    assert schema.names[0] == "Year" and schema.names[-1] == "IsDepDelayed"
