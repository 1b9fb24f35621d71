"""Assembly of the checking SQL: named CTEs with dependencies, all materialized."""

from beaconry.sources import audit_bindings, document_samples  # noqa: F401  (add their projections)
from beaconry.sources.bindings import LOGICAL, DuckSql

D = DuckSql()
CTES: dict[str, tuple[list[str], str]] = {name: ([], fn(D)) for name, fn in LOGICAL.items()}


def cte(name, deps, sql):
    CTES[name] = (deps, sql)


def _collect(names, seen):
    for n in names:
        if n not in seen:
            _collect(CTES[n][0], seen)
            seen.append(n)
    return seen


def query(deps, select):
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in _collect(deps, [])]
    return "WITH " + ",\n".join(parts) + "\n" + select


def us(text):
    """Instant in microseconds of a strict UTC text, null when it is anything else."""
    return f"epoch_us(try_strptime({text}, '%Y-%m-%dT%H:%M:%SZ'))"


def any_of(text, terms):
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def count_of(text, terms):
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


def list_of(text, terms):
    items = ", ".join(f"CASE WHEN contains({text}, '{t}') THEN '{t}' END" for t in sorted(terms))
    return f"list_filter([{items}], lambda t: t IS NOT NULL)"


def score(expr):
    return f"round_even(least(greatest({expr}, 0.0::DOUBLE), 100.0::DOUBLE), 0)::INT"


def joined(expr):
    return f"coalesce(array_to_string({expr}, '|'), '')"
