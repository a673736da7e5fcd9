"""Requests to a database by name, as a server in front of it would dispatch them."""

from __future__ import annotations

from ..registry import RegistryError
from .catalog import Database


def handle(database: Database, name: str, table: str, body: dict | None = None) -> object:
    """Answer one request.

    ``eadd`` adds an event ``{objectId, timestamp, actionId, data}``, or all of
    a list ``events`` of them in one write; ``aadd``,
    ``aget``, ``aall`` and ``padd``, ``pget``, ``pall`` add, get and list
    actions and properties; ``peach`` runs the path program in ``query``.
    Results are plain values, of ``peach`` a DataFrame.  A missing id gives None.
    """
    t, body = database.table(table), body or {}
    if name == "eadd":
        rows = []
        for event in body.get("events", [body]):
            data = event.get("data") or {}
            for key in data:
                if t.registry.property_named(key) is None:
                    raise RegistryError(f"unknown property: {key}")
            rows.append({"object_id": event["objectId"], "ts": event["timestamp"], "action_id": event.get("actionId"), **data})
        rejected = t.append_rows(rows).select("reason").collect()
        return {"status": "error", "reason": rejected[0][0]} if rejected else {"status": "ok"}
    if name == "aadd":
        return _action(t.add_action(body["name"]))
    if name == "aget":
        return _action(t.get_action(body["actionId"]))
    if name == "aall":
        return [_action(a) for a in t.registry.all_actions()]
    if name == "padd":
        return _property(t.add_property(body["type"], body["dataType"], body["name"]))
    if name == "pget":
        return _property(t.get_property(body["propertyId"]))
    if name == "pall":
        return [_property(p) for p in t.registry.all_properties()]
    if name == "peach":
        return t.query(body["query"])
    raise ValueError(f"unknown request: {name}")


def _action(a) -> dict | None:
    return a and {"id": a.id, "name": a.name}


def _property(p) -> dict | None:
    return p and {"id": p.id, "type": p.kind, "dataType": p.data_type, "name": p.name}
