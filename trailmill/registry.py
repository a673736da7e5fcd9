"""Registries of actions and properties: small, on the driver, saved with the table."""

from __future__ import annotations

from dataclasses import dataclass, field

from .types import ACTION, DATA_TYPES, MOST_ACTION, MOST_ACTION_ID, MOST_OBJECT, OBJECT, kind_of


class RegistryError(ValueError):
    pass


@dataclass(frozen=True)
class Action:
    id: int
    name: str


@dataclass(frozen=True)
class Property:
    id: int
    data_type: str
    name: str

    @property
    def kind(self) -> str:
        return kind_of(self.id)


@dataclass
class Registry:
    """Actions get ids 1, 2, 3, ...; object properties 1 to 127, action properties -1 to -128."""

    actions: dict[int, Action] = field(default_factory=dict)
    properties: dict[int, Property] = field(default_factory=dict)

    def add_action(self, name: str) -> Action:
        if not name:
            raise RegistryError("an action needs a name")
        if self.action_named(name):
            raise RegistryError(f"action exists: {name}")
        new = Action(max(self.actions, default=0) + 1, name)
        if new.id > MOST_ACTION_ID:
            raise RegistryError("no action id left")
        self.actions[new.id] = new
        return new

    def action(self, action_id: int) -> Action | None:
        return self.actions.get(action_id)

    def action_named(self, name: str) -> Action | None:
        return next((a for a in self.actions.values() if a.name == name), None)

    def all_actions(self) -> list[Action]:
        return [self.actions[i] for i in sorted(self.actions)]

    def add_property(self, kind: str, data_type: str, name: str) -> Property:
        if kind not in (OBJECT, ACTION):
            raise RegistryError(f"unknown kind of property: {kind}")
        if data_type not in DATA_TYPES:
            raise RegistryError(f"unknown data type: {data_type}")
        if not name or self.property_named(name):
            raise RegistryError(f"property exists or has no name: {name}")
        new_id = max([0, *self.properties]) + 1 if kind == OBJECT else min([0, *self.properties]) - 1
        if not MOST_ACTION <= new_id <= MOST_OBJECT:
            raise RegistryError(f"no id left for {kind} properties")
        new = Property(new_id, data_type, name)
        self.properties[new.id] = new
        return new

    def property(self, property_id: int) -> Property | None:
        return self.properties.get(property_id)

    def property_named(self, name: str) -> Property | None:
        return next((p for p in self.properties.values() if p.name == name), None)

    def all_properties(self) -> list[Property]:
        return [self.properties[i] for i in sorted(self.properties)]

    def to_dict(self) -> dict:
        return {
            "actions": [{"id": a.id, "name": a.name} for a in self.all_actions()],
            "properties": [{"id": p.id, "data_type": p.data_type, "name": p.name} for p in self.all_properties()],
        }

    @classmethod
    def from_dict(cls, d: dict) -> Registry:
        return cls({a["id"]: Action(**a) for a in d["actions"]}, {p["id"]: Property(**p) for p in d["properties"]})
