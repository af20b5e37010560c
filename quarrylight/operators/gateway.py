"""Tools over DataFrames: registry, roles, call budgets, schema checks, confirmation and an audit trail."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .retrieval import RequestContext


class ToolError(Exception):
    """A refused or failed call; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class ToolSpec:
    """What a tool is called, needs and may be asked; ``run(ctx, **arguments)`` gives a DataFrame."""

    name: str
    description: str
    run: Callable[..., DataFrame]
    arguments: dict = field(default_factory=dict)  # name -> (type, required)
    roles: tuple = ()
    per_session: int = 16
    confirm: bool = False

    def manifest(self) -> dict:
        names = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}
        return {
            "name": self.name,
            "description": self.description,
            "inputSchema": {
                "type": "object",
                "properties": {k: {"type": names[t]} for k, (t, _) in self.arguments.items()},
                "required": [k for k, (_, required) in self.arguments.items() if required],
            },
        }


class Registry:
    def __init__(self):
        self._tools: dict[str, ToolSpec] = {}

    def register(self, spec: ToolSpec) -> ToolSpec:
        if spec.name in self._tools:
            raise ToolError("duplicate_tool", spec.name)
        self._tools[spec.name] = spec
        return spec

    def get(self, name: str) -> ToolSpec:
        if name not in self._tools:
            raise ToolError("unknown_tool", name)
        return self._tools[name]

    def manifest(self, roles: tuple = ()) -> list[dict]:
        return [t.manifest() for _, t in sorted(self._tools.items()) if allowed(roles, t)]


def allowed(roles: tuple, spec: ToolSpec) -> bool:
    """No requirement, or a shared role."""
    return not spec.roles or bool(set(roles) & set(spec.roles))


@dataclass
class Budget:
    """Calls per tool and in all."""

    total: int = 64
    used: dict = field(default_factory=dict)

    def take(self, spec: ToolSpec) -> None:
        if sum(self.used.values()) >= self.total:
            raise ToolError("session_budget")
        if self.used.get(spec.name, 0) >= spec.per_session:
            raise ToolError("tool_budget", spec.name)
        self.used[spec.name] = self.used.get(spec.name, 0) + 1


class Router:
    """Looks a tool up, checks role, budget, arguments and confirmation, runs it, and records every call."""

    def __init__(self, registry: Registry, secret: str = ""):
        self.registry, self._secret, self._audit = registry, secret, []

    def token(self, ctx: RequestContext, name: str, arguments: dict) -> str:
        text = "\n".join([self._secret, ctx.tenant, name, repr(sorted(arguments.items()))])
        return hashlib.sha256(text.encode()).hexdigest()[:32]

    def call(self, ctx: RequestContext, name: str, arguments: dict, budget: Budget, confirm: str | None = None) -> DataFrame:
        began, outcome = time.time(), "error"
        try:
            spec = self.registry.get(name)
            if not allowed(ctx.roles, spec):
                raise ToolError("forbidden", name)
            budget.take(spec)
            for key, (kind, required) in spec.arguments.items():
                if key not in arguments:
                    if required:
                        raise ToolError("missing_argument", key)
                elif not isinstance(arguments[key], kind) or (kind is int and isinstance(arguments[key], bool)):
                    raise ToolError("wrong_type", key)
            if extra := set(arguments) - set(spec.arguments):
                raise ToolError("unknown_argument", ", ".join(sorted(extra)))
            if spec.confirm and confirm != self.token(ctx, name, arguments):
                raise ToolError("confirmation_required", self.token(ctx, name, arguments))
            out = spec.run(ctx, **arguments)
            outcome = "ok"
            return out
        except ToolError as e:
            outcome = e.code
            raise
        finally:
            self._audit.append((ctx.tenant, list(ctx.roles), name, outcome, sorted(arguments), time.time() - began))

    def audit(self, spark: SparkSession) -> DataFrame:
        """One row per call: argument names alone, never their values."""
        return spark.createDataFrame(self._audit, "tenant_id string, roles array<string>, tool string, outcome string, arg_keys array<string>, latency double")
