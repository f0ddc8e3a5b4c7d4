"""The ordered queue machine, replayed from a log of its commands.

A queue's state depends on every command before, so each queue is one ordered pass;
queues run in parallel, and only the columns of the commands travel. Messages are
numbered as they enter; those that come back go out first, in the order of their return,
then the lowest. Consumers with room are served in turn.
"""

from __future__ import annotations

from collections import OrderedDict, deque

from pyspark.sql import DataFrame

from tideline.functions.ordered import ordered_rows

COMMANDS = ["event", "pid", "seqno", "ids", "life", "credit"]


class _Consumer:
    __slots__ = ("life", "credit", "held", "following", "seen", "suspect")

    def __init__(self):
        self.held, self.following, self.seen, self.suspect = {}, 0, 0, False


class Queue:
    """State of one queue. Messages are ``[number, log index of the enqueue, returns]``."""

    def __init__(self):
        self.waiting, self.returned, self.entered = deque(), deque(), 0
        self.consumers: dict = {}
        self.service: OrderedDict = OrderedDict()
        self.expected: dict = {}  # producer: next sequence number, early messages
        self.settled = self.dead = self.purged = self.duplicates = 0

    def enter(self, idx: int) -> None:
        self.waiting.append([self.entered, idx, 0])
        self.entered += 1

    def enqueue(self, idx: int, pid, seqno) -> list:
        """Exactly once for producers that number their messages: duplicates are refused,
        early ones wait for those before them."""
        if seqno is None:
            self.enter(idx)
            return self.deliver(idx)
        following, early = self.expected.setdefault(pid, [1, {}])
        if seqno < following:
            self.duplicates += 1
            return [(idx, "duplicate", pid, None, None, None)]
        # One that is early twice is kept twice, and blocks what is behind it once reached.
        early.setdefault(seqno, []).append(idx)
        while following in early:
            self.enter(early[following].pop(0))
            if not early[following]:
                del early[following]
            following += 1
        self.expected[pid][0] = following
        return self.deliver(idx)

    def wants(self, name, c: _Consumer) -> None:
        """After a change: a consumer with room queues for service, one that is done goes."""
        if c.life == "once" and c.seen == c.credit:
            if not c.held:
                del self.consumers[name]
        elif c.life == "once" or len(c.held) < c.credit:
            self.service.setdefault(name)

    def serve(self, idx: int, kind: str) -> tuple | None:
        """Hand one message to the consumer whose turn it is."""
        while self.service and (self.returned or self.waiting):
            name, _ = self.service.popitem(last=False)
            c = self.consumers.get(name)
            if c is None:
                continue
            m = self.returned.popleft() if self.returned else self.waiting.popleft()
            number, c.following, c.seen = c.following, c.following + 1, c.seen + 1
            c.held[number] = m
            self.wants(name, c)
            return idx, kind, name, number, m[1], m[2]
        return None

    def deliver(self, idx: int) -> list:
        out = []
        while (row := self.serve(idx, "delivery")) is not None:
            out.append(row)
        return out

    def checkout(self, name, life: str, credit: int) -> None:
        c = self.consumers.setdefault(name, _Consumer())
        c.life, c.credit = life, credit
        if len(c.held) < credit:
            self.service.setdefault(name)

    def finish(self, idx: int, name, ids: list, dead: bool) -> list:
        c = self.consumers.get(name)
        if c is None:
            return []
        gone = [(n, c.held.pop(n)) for n in sorted(set(ids)) if n in c.held]
        out = [(idx, "dead_letter", name, n, m[1], m[2]) for n, m in gone] if dead else []
        self.dead, self.settled = self.dead + len(gone) * dead, self.settled + len(gone) * (not dead)
        self.wants(name, c)
        return out + self.deliver(idx)

    def give_back(self, messages) -> None:
        for m in messages:
            m[2] += 1
            self.returned.append(m)

    def take_back(self, idx: int, name, ids: list) -> list:
        c = self.consumers.get(name)
        if c is None:
            return []
        back = [c.held.pop(n) for n in sorted(set(ids)) if n in c.held]
        if c.life == "auto":
            c.seen -= len(back)
        self.wants(name, c)
        self.give_back(back)
        return self.deliver(idx)

    def cancel(self, name) -> None:
        c = self.consumers.pop(name, None)
        if c:
            self.give_back(m for _, m in sorted(c.held.items()))

    def dequeue(self, idx: int, name, settle: bool) -> list:
        if not self.waiting and not self.returned:
            return [(idx, "empty", name, None, None, None)]
        self.checkout(name, "once", 1)
        row = self.serve(idx, "dequeue")
        if row is None:
            return [(idx, "empty", name, None, None, None)]
        return [row, *(self.finish(idx, name, [row[3]], False) if settle else [])]

    def purge(self, idx: int) -> list:
        n = len(self.waiting) + len(self.returned)
        for name, c in list(self.consumers.items()):
            n += len(c.held)
            c.held = {}
            self.wants(name, c)
        self.waiting.clear()
        self.returned.clear()
        self.purged += n
        return [(idx, "purge", None, n, None, None)]

    def down(self, idx: int, pid) -> list:
        _, early = self.expected.pop(pid, (None, {}))
        for seqno in sorted(early):
            for at in early[seqno]:
                self.enter(at)
        self.cancel(pid)
        return self.deliver(idx)

    def apply(self, idx: int, event: str, pid, seqno, ids, life, credit) -> list:
        match event:
            case "enqueue":
                return self.enqueue(idx, pid, seqno)
            case "checkout":
                self.checkout(pid, life, credit)
                return self.deliver(idx)
            case "settle" | "discard":
                return self.finish(idx, pid, ids or [], event == "discard") if self.consumers else []
            case "return":
                return self.take_back(idx, pid, ids or [])
            case "dequeue":
                return self.dequeue(idx, pid, life == "settled")
            case "cancel":
                self.cancel(pid)
                return self.deliver(idx)
            case "purge":
                return self.purge(idx)
            case "down":
                return self.down(idx, pid)
            case "noconnection":
                if pid in self.consumers:
                    self.consumers[pid].suspect = True
                return []
            case "nodeup":
                return [(idx, "monitor", name, None, None, None) for name in sorted(n for n, c in self.consumers.items() if c.suspect)]
        return []

    def overview(self) -> list:
        held = sum(len(c.held) for c in self.consumers.values())
        early = sum(len(v) for _, e in self.expected.values() for v in e.values())
        ready = len(self.waiting) + len(self.returned)
        return [(self.entered, ready, held, early, self.settled, self.dead, self.purged, self.duplicates, len(self.consumers))]


def effects(commands: DataFrame) -> DataFrame:
    """``queue, idx, kind, consumer, msg_id, enqueued, returns``: what each command leads to.

    ``commands``: ``queue, idx, event, pid, seqno, ids array<long>, life, credit``. Kinds:
    ``delivery`` of the message enqueued at ``enqueued`` as the consumer's ``msg_id``, ``dequeue``,
    ``empty``, ``dead_letter``, ``duplicate``, ``purge`` (``msg_id`` counts), ``monitor``. Unknown
    consumers, message ids and events change nothing.
    """
    fields = "queue long, idx long, kind string, consumer long, msg_id long, enqueued long, returns long"
    return ordered_rows(commands, ["queue"], ["idx"], ["idx", *COMMANDS], fields, Queue, Queue.apply)


def overview(commands: DataFrame) -> DataFrame:
    """``queue, entered, ready, checked_out, early, settled, dead, purged, duplicates, consumers`` of
    each queue after its commands."""
    fields = "queue long, " + ", ".join(f"{n} long" for n in "entered ready checked_out early settled dead purged duplicates consumers".split())

    def step(state: Queue, *row) -> list:
        state.apply(*row)
        return []

    return ordered_rows(commands, ["queue"], ["idx"], ["idx", *COMMANDS], fields, Queue, step, Queue.overview)
