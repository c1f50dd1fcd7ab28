"""User detectors and readers, switched on and off by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.spans import DETECTIONS, no_detections


@dataclass
class Detector:
    """A function from a text column to an array of hits; higher ``priority`` comes first."""

    name: str
    detect: Callable[[Column], Column]
    pii_types: Sequence[str]
    priority: int = 0
    enabled: bool = True
    kind: str = field(default="detector", init=False)


@dataclass
class Reader:
    """A function from a path to ``sections`` rows, for the given file endings."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    source_type: str
    extensions: Sequence[str]
    enabled: bool = True
    kind: str = field(default="reader", init=False)


class Registry:
    """Registered plug-ins. Disabled ones leave no expression in any plan."""

    def __init__(self) -> None:
        self._plugins: dict[str, Detector | Reader] = {}

    def register(self, plugin: Detector | Reader) -> None:
        self._plugins[plugin.name] = plugin

    def get(self, name: str) -> Detector | Reader | None:
        return self._plugins.get(name)

    def unload(self, name: str) -> bool:
        return self._plugins.pop(name, None) is not None

    def unload_all(self) -> None:
        self._plugins.clear()

    def enable(self, name: str, enabled: bool = True) -> bool:
        plugin = self.get(name)
        if plugin is None:
            return False
        plugin.enabled = enabled
        return True

    def disable(self, name: str) -> bool:
        return self.enable(name, False)

    def listing(self) -> list[dict]:
        return [{"name": p.name, "kind": p.kind, "enabled": p.enabled} for p in self._plugins.values()]

    def of_kind(self, kind: str, enabled_only: bool = True) -> list[Detector | Reader]:
        return [p for p in self._plugins.values() if p.kind == kind and (p.enabled or not enabled_only)]

    def detectors(self) -> list[Detector]:
        return sorted(self.of_kind("detector"), key=lambda p: -p.priority)

    def detections(self, text: Column) -> Column:
        """Hits of all enabled detectors in order of priority."""
        arrays = [F.coalesce(d.detect(text).cast(DETECTIONS), no_detections()) for d in self.detectors()]
        return F.concat(*arrays) if arrays else no_detections()

    def reader_for(self, extension: str) -> Reader | None:
        ext = extension.lower()
        return next((p for p in self.of_kind("reader") if ext in p.extensions), None)
