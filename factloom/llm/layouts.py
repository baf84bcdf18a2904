"""Which layout a record has, by a hash of its nested field paths, and the turns that it holds.

A layout is declared, not programmed: where the turns are, and which paths hold a turn's role
and text. Each one's possible sets of paths (fields may be missing, lists null or empty) are
hashed beforehand; a record's own paths are hashed alike, and its fingerprint picks the layout
by one lookup. Fields that no layout knows don't count.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import xxhash

#: Other names of roles, as the data formats have them.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a conversation's turns are.

    turns: (role, path) for fields that are turns themselves, in order; a missing one is no turn.
    many: path of a list of turns, each with ``role`` and ``text`` (or a list of texts, whose
    roles alternate from ``first``). lead: fields that stand before them, as turns.
    row: the record is a single turn with ``role`` and ``text``, at ``order``.
    key: the conversation's id.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    lead: tuple[tuple[str, str], ...] = ()
    many: str = ""
    row: bool = False
    role: str = ""
    text: str = ""
    order: str = ""
    key: str = "conv_id"
    needed: frozenset[str] = field(default_factory=frozenset)

    def paths(self) -> tuple[set[str], set[str]]:
        """Paths that a record of this layout must have, and those that it may have."""
        if self.row:
            return {self.role, self.text}, {self.order, self.key}
        lead = {p for _, p in self.lead}
        if self.many:
            return set(), {self.key, *lead}
        every = {p for _, p in self.turns}
        return set(self.needed), every - self.needed | {self.key}

    def variants(self) -> list[set[str]]:
        must, may = self.paths()
        out = [must | set(some) for n in range(len(may) + 1) for some in combinations(sorted(may), n)]
        if not self.many:
            return out
        # a list's own path stands for one that is null or empty
        items = [{self.many}, {f"{self.many}[]"}]
        if self.role:
            r, t = f"{self.many}[].{self.role}", f"{self.many}[].{self.text}"
            items = [{self.many}, {r, t}, {t}, {r}]
        return [v | i for v in out for i in items]


#: Layouts of public conversation and instruction data: fixed field names.
LAYOUTS = (
    Layout("rows", row=True, role="role", text="text", order="turn"),
    Layout("messages", many="messages", role="role", text="content", lead=(("system", "system"),)),
    Layout("conversations", many="conversations", role="from", text="value", lead=(("system", "system"),)),
    Layout("dialogue", many="conversation.turns", role="speaker", text="utterance"),
    Layout("texts", many="data"),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), needed=frozenset({"instruction", "output"})),
    Layout("prompt_completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), needed=frozenset({"prompt", "completion"})),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), needed=frozenset({"prompt", "response"})),
    Layout("question_answer", turns=(("system", "system_prompt"), ("user", "question"), ("assistant", "response")), needed=frozenset({"question", "response"})),
    Layout("nested", turns=(("system", "input.system"), ("user", "input.prompt"), ("assistant", "output.text")), needed=frozenset({"input.prompt", "output.text"})),
)


def paths_of(value, at: str = "") -> set[str]:
    """The paths of a record's fields; a list's items share one path, a null or empty list has its own."""
    if isinstance(value, dict):
        out = set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
        return out
    if isinstance(value, list) and value:
        return set().union(*(paths_of(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


class Registry:
    """Layouts by fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.known: set[str] = set()
        self.by_print: dict[int, Layout] = {}
        for layout in layouts:
            for variant in layout.variants():
                self.known |= variant
                taken = self.by_print.setdefault(fingerprint(variant), layout)
                if taken is not layout:
                    raise ValueError(f"layouts {taken.name} and {layout.name} share the paths {sorted(variant)}")

    def find(self, record: dict) -> tuple[int, Layout | None]:
        print_ = fingerprint(paths_of(record) & self.known)
        return print_, self.by_print.get(print_)


def at_path(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def as_text(value) -> str:
    """Null is empty; half a surrogate pair, which JSON can spell, becomes a question mark."""
    out = "" if value is None else value if isinstance(value, str) else str(value)
    return out if out.isascii() else out.encode("utf-8", "replace").decode("utf-8")


def turns_of(layout: Layout, record: dict) -> list[tuple[str, str]]:
    """(role, text) of a record, in order; a null text is empty, a null role too."""
    if layout.row:
        return [(as_text(at_path(record, layout.role)), as_text(at_path(record, layout.text)))]
    out = [(role, as_text(at_path(record, path))) for role, path in (*layout.lead, *layout.turns) if at_path(record, path) is not None]
    for i, item in enumerate(at_path(record, layout.many) or [] if layout.many else []):
        if layout.role:
            role = as_text(at_path(item, layout.role))
            out.append((ROLES.get(role, role), as_text(at_path(item, layout.text))))
        else:
            out.append(("assistant" if i % 2 else "user", as_text(item)))
    return out
