"""Query registry: each name has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
# shared SQL sub-queries: name -> (names it needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def sql(body: str, *names: str) -> str:
    """``body`` with the shared sub-queries it names, dependencies first."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for need in CTES[n][0]:
            visit(need)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def query(name: str, oracle: str | None = None):
    def keep(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return keep
