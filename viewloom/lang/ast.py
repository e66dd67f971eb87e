"""What statements are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field

Value = int | str | bool | tuple[int, int]


@dataclass(frozen=True)
class Variable:
    """A property: of the edge or vertex itself (side ''), or of an edge's source (u) or target (v). ``e`` alone is the pair of ids."""

    name: str
    side: str = ""

    def __str__(self) -> str:
        return f"{self.side}.{self.name}" if self.side else self.name


@dataclass(frozen=True)
class Predicate:
    left: Variable
    op: str
    right: Variable | Value

    def __str__(self) -> str:
        right = f"'{self.right}'" if isinstance(self.right, str) else str(self.right).lower() if isinstance(self.right, bool) else str(self.right)
        return f"{self.left} {self.op} {right}"


@dataclass(frozen=True)
class Condition:
    """A conjunction, negated or not."""

    predicates: tuple[Predicate, ...]
    negated: bool = False

    def __str__(self) -> str:
        text = " and ".join(map(str, self.predicates))
        return f"!({text})" if self.negated else text


Where = tuple[Condition, ...]


@dataclass(frozen=True)
class Aggregate:
    name: str
    function: str
    argument: str


@dataclass
class Section:
    """Of a view: WHERE, GROUP BY and AGGREGATE over vertices or edges.

    A group clause is a list whose parts are each a variable name, one conjunction, or a list of conjunctions.
    """

    where: Where = ()
    groups: list[list[str | list[Where]]] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    label: str | None = None
    between: tuple[str, str] | None = None


@dataclass
class Statement:
    """kind, and its arguments by name."""

    kind: str
    args: dict


def text_of(where: Where) -> str:
    return " and ".join(map(str, where))
