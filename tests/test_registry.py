import pytest

from trailmill.registry import Registry, RegistryError


def test_actions_count_up():
    r = Registry()
    assert [r.add_action(n).id for n in ("a", "b")] == [1, 2]
    assert r.action(2).name == "b" and r.action(3) is None and [a.name for a in r.all_actions()] == ["a", "b"]
    with pytest.raises(RegistryError):
        r.add_action("a")
    with pytest.raises(RegistryError):
        r.add_action("")


def test_property_ids_tell_the_kind():
    r = Registry()
    ids = [r.add_property(k, "Int", n).id for k, n in (("object", "a"), ("action", "b"), ("action", "c"), ("object", "d"))]
    assert ids == [1, -1, -2, 2] and [p.kind for p in r.all_properties()] == ["action", "action", "object", "object"]
    for bad in (("object", "Int", "b"), ("thing", "Int", "x"), ("object", "Date", "x"), ("object", "Int", "")):
        with pytest.raises(RegistryError):
            r.add_property(*bad)


def test_ids_run_out():
    r = Registry()
    for i in range(127):
        r.add_property("object", "Int", f"o{i}")
    for i in range(128):
        r.add_property("action", "Int", f"a{i}")
    for kind in ("object", "action"):
        with pytest.raises(RegistryError):
            r.add_property(kind, "Int", "more")


def test_round_trip():
    r = Registry()
    r.add_action("x")
    r.add_property("action", "Float", "y")
    assert Registry.from_dict(r.to_dict()) == r
