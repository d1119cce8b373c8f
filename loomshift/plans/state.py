"""The review around a plan: versioned artifacts, feedback, and phases that become stale together."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from .store import Store

#: Phases in order.
PHASES = ("setup", "discovery", "analysis", "mapping", "sql", "ready", "transfer", "complete")


class StateFault(RuntimeError):
    pass


@dataclass
class Feedback:
    anchor: str
    text: str
    status: str = "draft"  # then open; addressed, declined or superseded


@dataclass
class Project:
    status: dict[str, str] = field(default_factory=lambda: {p: "pending" for p in PHASES})
    versions: dict[str, list[tuple[str, object]]] = field(default_factory=dict)
    feedback: dict[str, list[Feedback]] = field(default_factory=dict)
    started: bool = False

    def add_version(self, phase: str, author: str, payload, base: int | None = None) -> int:
        """Append a version; version 0 is the engine's draft. base: the version that the author saw."""
        held = self.versions.setdefault(phase, [])
        if held and base is not None and base != len(held) - 1:
            raise StateFault(f"version {base} is not the current one, {len(held) - 1}")
        open_items = [f for f in self.feedback.get(phase, []) if f.status == "open"]
        if author == "agent" and open_items:
            raise StateFault(f"{len(open_items)} open remark(s) have no response")
        held.append((author, payload))
        self.status[phase] = "awaiting_review"
        return len(held) - 1

    def current(self, phase: str):
        return self.versions[phase][-1][1]

    def remark(self, phase: str, anchor: str, text: str) -> Feedback:
        item = Feedback(anchor, text)
        self.feedback.setdefault(phase, []).append(item)
        return item

    def send(self, phase: str) -> None:
        drafts = [f for f in self.feedback.get(phase, []) if f.status == "draft"]
        if not drafts:
            raise StateFault("no remarks to send")
        for f in drafts:
            f.status = "open"
        self.status[phase] = "reworking"

    def respond(self, item: Feedback, addressed: bool) -> None:
        if item.status != "open":
            raise StateFault("the remark is not open")
        item.status = "addressed" if addressed else "declined"

    def approve(self, phase: str, seen: int, blockers: list[str] = ()) -> None:
        if self.status[phase] != "awaiting_review":
            raise StateFault(f"{phase} is not awaiting review")
        if seen != len(self.versions[phase]) - 1:
            raise StateFault("the version seen is not the current one")
        if blockers:
            raise StateFault("; ".join(blockers))
        self.status[phase] = "approved"

    def reopen(self, phase: str) -> None:
        """Back to review; what followed, up to ready, is stale."""
        if self.started and self.status["transfer"] not in ("approved", "cancelled"):
            raise StateFault("a run has begun")
        if self.status[phase] != "approved":
            raise StateFault(f"{phase} is not approved")
        self.status[phase] = "awaiting_review"
        for p in PHASES[PHASES.index(phase) + 1 : PHASES.index("ready") + 1]:
            if self.status[p] != "pending":
                self.status[p] = "stale"
        self.status["transfer"], self.started = "pending", False

    def supersede(self, phase: str) -> None:
        """Remarks that were never answered fall with the version that they spoke of."""
        for f in self.feedback.get(phase, []):
            if f.status in ("draft", "open"):
                f.status = "superseded"

    def save(self, store: Store, name: str = "project") -> int:
        """Write the review as a new numbered file, whole or not at all, and return its number."""
        number = len(store.names(f"_review/{name}")) + 1
        value = {"status": self.status, "versions": self.versions, "feedback": {p: [asdict(f) for f in x] for p, x in self.feedback.items()}, "started": self.started}
        store.write_new(f"_review/{name}/{number:08d}.json", value)
        return number

    @classmethod
    def load(cls, store: Store, name: str = "project") -> Project | None:
        """The review as it was saved last."""
        numbers = [n for n in store.names(f"_review/{name}") if n.endswith(".json") and not n.startswith("_")]
        if not numbers:
            return None
        told = store.read_json(f"_review/{name}/{numbers[-1]}")
        feedback = {p: [Feedback(**f) for f in x] for p, x in told["feedback"].items()}
        return cls(told["status"], {p: [tuple(v) for v in x] for p, x in told["versions"].items()}, feedback, told["started"])

    def next(self) -> tuple[str, str]:
        """(phase, what it waits for) of the first phase that is not approved."""
        for p in PHASES:
            if self.status[p] != "approved":
                waits = {"awaiting_review": "await", "pending": "agent", "reworking": "agent", "drafting": "agent", "stale": "agent", "running": "await"}
                return p, waits.get(self.status[p], "stop")
        return PHASES[-1], "stop"
