"""What sources, steps and sinks have in common."""

from __future__ import annotations

import logging


class Component:
    """A configured part of a pipeline; ``kind`` is what it is, its class name what it is called."""

    kind = "Component"

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def logger(self) -> logging.Logger:
        return logging.getLogger(f"tributary.{self.name}")

    def __str__(self) -> str:
        return f"{self.kind} Object of Class {self.name}"
