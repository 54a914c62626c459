"""Syntax tree of a criterion, its canonical text and its weaker AND/OR/NOT form.

Precedence: AND-like operators (E, ADJ, ADJC, PROX, PROXC, COM, MESMO) bind tighter than OU and NAO;
beyond that evaluation runs from left to right inside a pair of parentheses.
"""

from __future__ import annotations

from dataclasses import dataclass

NUMBERED = ("ADJ", "ADJC", "PROX", "PROXC", "COM")


class CriterionError(ValueError):
    """A criterion that breaks the language's rules."""


@dataclass(frozen=True)
class Term:
    word: str
    quoted: bool = False

    @property
    def wild(self) -> bool:
        return "$" in self.word or "?" in self.word


@dataclass(frozen=True)
class Scope:
    """Positions of ``of`` in one field."""

    of: Node
    field: str


@dataclass(frozen=True)
class Compare:
    """Whether a field has a token that compares with ``value`` as asked."""

    field: str
    sign: str
    value: str


@dataclass(frozen=True)
class Binary:
    """``left name left`` for E, OU, NAO, MESMO and the numbered operators."""

    name: str
    left: Node
    right: Node
    number: int = 1


@dataclass(frozen=True)
class Absent:
    """NAO in front of an operand."""

    of: Node


@dataclass(frozen=True)
class Blank:
    """The criterion <vazio>: a text without words."""


Node = Term | Scope | Compare | Binary | Absent | Blank

AND_LIKE = ("E", "MESMO", *NUMBERED)


def special(node: Node) -> bool:
    """Whether matching needs positions, and not only which words a document has."""
    match node:
        case Binary():
            return node.name in (*NUMBERED, "MESMO") or special(node.left) or special(node.right)
        case Scope() | Absent():
            return special(node.of)
    return False


def words_of(node: Node) -> list[Term]:
    """All terms, negated ones included, in order."""
    match node:
        case Term():
            return [node]
        case Scope() | Absent():
            return words_of(node.of)
        case Binary():
            return words_of(node.left) + words_of(node.right)
    return []


def canonical(node: Node) -> str:
    """A text that parses to the same tree."""

    def inner(n: Node) -> str:
        return f"({canonical(n)})" if isinstance(n, Binary | Absent) else canonical(n)

    match node:
        case Blank():
            return "<vazio>"
        case Term():
            return f'"{node.word}"' if node.quoted else node.word
        case Compare():
            return f"{node.value}.{node.field.lower()}{node.sign}."
        case Scope():
            return f"{inner(node.of)}.{node.field.lower()}."
        case Absent():
            return f"NAO {inner(node.of)}"
        case Binary():
            name = f"{node.name}{node.number}" if node.name in NUMBERED else node.name
            return f"{inner(node.left)} {name} {inner(node.right)}"
    raise TypeError(node)


def weaker(node: Node) -> Node | None:
    """A condition on words alone that holds wherever ``node`` matches; None if every document may match.

    Operators become E, fields are dropped, what is negated is dropped.
    """
    match node:
        case Term():
            return node if node.word.strip("$?") else None
        case Scope():
            return weaker(node.of)
        case Binary(name="OU"):
            left, right = weaker(node.left), weaker(node.right)
            return None if left is None or right is None else Binary("OU", left, right)
        case Binary(name="NAO"):
            return weaker(node.left)
        case Binary():
            left, right = weaker(node.left), weaker(node.right)
            return right if left is None else left if right is None else Binary("E", left, right)
    return None


def and_or_not(node: Node) -> str:
    """Text of the AND/OR/NOT form for a full-text index: negations stay where they need no positions."""

    def build(n: Node) -> tuple[str, bool] | None:
        match n:
            case Term():
                bare = n.word.lstrip("$?").replace("$", "*")
                return (f'"{bare}"' if n.quoted and not n.wild else bare, False) if bare else None
            case Scope():
                return build(n.of)
            case Absent():
                of = None if special(n.of) or holds_field(n.of) else build(n.of)
                return of and (f"NOT {wrap(of)}", True)
            case Binary():
                left, right = build(n.left), build(n.right)
                if n.name == "NAO":
                    right = None if special(n.right) or holds_field(n.right) else right
                if left is None or right is None:
                    return None if n.name == "OU" else left if n.name == "NAO" else left or right
                name = {"OU": "OR", "NAO": "NOT"}.get(n.name, "AND")
                return f"{wrap(left)} {name} {wrap(right)}", True
        return None

    def wrap(part: tuple[str, bool]) -> str:
        return f"({part[0]})" if part[1] else part[0]

    found = build(node)
    return found[0] if found else ""


def holds_field(node: Node) -> bool:
    match node:
        case Scope() | Compare():
            return True
        case Absent():
            return holds_field(node.of)
        case Binary():
            return holds_field(node.left) or holds_field(node.right)
    return False
