"""The queue machine against known cases and a plain version that keeps lists."""

import random
from collections import Counter

import pytest

from tideline.operators import fifo
from tideline.plans import registry

FIELDS = "queue long, idx long, event string, pid long, seqno long, ids array<long>, life string, credit long"


def run(spark, commands):
    rows = [(q, i, e, pid, seqno, ids, life, credit) for q, i, e, pid, seqno, ids, life, credit in commands]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


def enq(i, pid=None, seqno=None, q=1):
    return (q, i, "enqueue", pid, seqno, None, None, None)


def cmd(i, event, pid=None, ids=None, life=None, credit=None, q=1):
    return (q, i, event, pid, None, ids, life, credit)


def test_credit_turns_and_returns(spark):
    log = [enq(1), enq(2), cmd(3, "checkout", 7, life="auto", credit=1), cmd(4, "checkout", 8, life="auto", credit=2), enq(5), cmd(6, "return", 7, [0]),
           cmd(7, "settle", 8, [0, 1, 99]), cmd(8, "down", 7), cmd(9, "settle", 9, [0])]
    got = [tuple(r)[1:] for r in fifo.effects(run(spark, log)).orderBy("idx", "enqueued").collect()]
    assert got == [(3, "delivery", 7, 0, 1, 0), (4, "delivery", 8, 0, 2, 0), (5, "delivery", 8, 1, 5, 0), (6, "delivery", 7, 1, 1, 1), (8, "delivery", 8, 2, 1, 2)]
    r = fifo.overview(run(spark, log)).first()
    assert (r.entered, r.ready, r.checked_out, r.settled, r.consumers) == (3, 0, 1, 2, 1)


def test_numbers_duplicates_and_early_messages(spark):
    log = [enq(1, 5, 2), enq(2, 5, 1), enq(3, 5, 1), enq(4, 5, 4), cmd(5, "dequeue", 6, life="settled"), cmd(6, "down", 5), cmd(7, "dequeue", 6, life="unsettled"), cmd(8, "dequeue", 6, life="settled"), cmd(9, "dequeue", 6, life="settled")]
    got = [(r.idx, r.kind, r.enqueued) for r in fifo.effects(run(spark, log)).orderBy("idx").collect()]
    assert got == [(3, "duplicate", None), (5, "dequeue", 2), (7, "dequeue", 1), (8, "empty", None), (9, "empty", None)]  # 6 still holds one


def test_once_consumers_leave_and_purge_empties(spark):
    log = [enq(1), enq(2), enq(3), cmd(4, "checkout", 7, life="once", credit=2), cmd(5, "settle", 7, [0]), cmd(6, "discard", 7, [1]), cmd(7, "checkout", 8, life="auto", credit=5), cmd(8, "purge"), enq(9)]
    got = [(r.idx, r.kind, r.consumer, r.msg_id, r.enqueued) for r in fifo.effects(run(spark, log)).orderBy("idx", "msg_id").collect()]
    assert got == [(4, "delivery", 7, 0, 1), (4, "delivery", 7, 1, 2), (6, "dead_letter", 7, 1, 2), (7, "delivery", 8, 0, 3), (8, "purge", None, 1, None), (9, "delivery", 8, 1, 9)]
    r = fifo.overview(run(spark, log)).first()
    assert (r.consumers, r.purged, r.dead, r.settled, r.checked_out) == (1, 1, 1, 1, 1)


class Plain:
    """The same rules, on lists that are searched from the start."""

    def __init__(self):
        self.ready, self.line, self.cons, self.next, self.early = [], [], {}, {}, []
        self.n = 0

    def put(self, idx):
        self.ready.append((1, self.n, idx, 0))
        self.n += 1

    def again(self, c):
        s = self.cons[c]
        if s["life"] == "once" and s["seen"] == s["credit"]:
            if not s["held"]:
                del self.cons[c]
        elif (s["life"] == "once" or len(s["held"]) < s["credit"]) and c not in self.line:
            self.line.append(c)

    def one(self, idx, kind):
        while self.line and self.ready:
            c = self.line.pop(0)
            if c in self.cons:
                back = [m for m in self.ready if m[0] == 0]
                m = back[0] if back else min(self.ready, key=lambda m: m[1])
                self.ready.remove(m)
                s = self.cons[c]
                k, s["k"], s["seen"] = s["k"], s["k"] + 1, s["seen"] + 1
                s["held"][k] = m
                self.again(c)
                return [(idx, kind, c, k, m[2], m[3])]
        return []

    def all(self, idx):
        out = []
        while x := self.one(idx, "delivery"):
            out += x
        return out

    def give(self, ms):
        self.ready += [(0, m[1], m[2], m[3] + 1) for m in ms]

    def add(self, c, life, credit):
        s = self.cons.setdefault(c, {"held": {}, "k": 0, "seen": 0, "lost": False})
        s["life"], s["credit"] = life, credit
        if len(s["held"]) < credit and c not in self.line:
            self.line.append(c)

    def done(self, idx, c, ids, dead):
        if c not in self.cons:
            return []
        s = self.cons[c]
        out = [(idx, "dead_letter", c, k, s["held"][k][2], s["held"][k][3]) for k in sorted(s["held"]) if k in ids and dead]
        s["held"] = {k: m for k, m in s["held"].items() if k not in ids}
        self.again(c)
        return out + self.all(idx)

    def apply(self, idx, e, p, q, ids, life, credit):
        if e == "enqueue":
            if q is None:
                self.put(idx)
                return self.all(idx)
            if q < self.next.setdefault(p, 1):
                return [(idx, "duplicate", p, None, None, None)]
            self.early.append((p, q, idx))
            while found := sorted(x for x in self.early if x[:2] == (p, self.next[p])):
                self.early.remove(found[0])
                self.put(found[0][2])
                self.next[p] += 1
            return self.all(idx)
        if e == "checkout":
            self.add(p, life, credit)
            return self.all(idx)
        if e in ("settle", "discard"):
            return self.done(idx, p, ids, e == "discard")
        if e == "return":
            if p not in self.cons:
                return []
            s = self.cons[p]
            back = [s["held"].pop(k) for k in sorted(s["held"]) if k in ids]
            s["seen"] -= len(back) if s["life"] == "auto" else 0
            self.again(p)
            self.give(back)
            return self.all(idx)
        if e == "dequeue":
            if not self.ready:
                return [(idx, "empty", p, None, None, None)]
            self.add(p, "once", 1)
            x = self.one(idx, "dequeue")
            return x + (self.done(idx, p, [x[0][3]], False) if x and life == "settled" else []) if x else [(idx, "empty", p, None, None, None)]
        if e in ("cancel", "down"):
            if e == "down":
                for x in sorted(x for x in self.early if x[0] == p):
                    self.early.remove(x)
                    self.put(x[2])
                self.next.pop(p, None)
            if p in self.cons:
                self.give(m for _, m in sorted(self.cons.pop(p)["held"].items()))
            return self.all(idx)
        if e == "purge":
            n = len(self.ready) + sum(len(s["held"]) for s in self.cons.values())
            self.ready = []
            for c in list(self.cons):
                self.cons[c]["held"] = {}
                self.again(c)
            return [(idx, "purge", None, n, None, None)]
        if e == "noconnection" and p in self.cons:
            self.cons[p]["lost"] = True
        if e == "nodeup":
            return [(idx, "monitor", c, None, None, None) for c in sorted(self.cons) if self.cons[c]["lost"]]
        return []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_queries_against_the_plain_version(spark, sf):
    from tideline.plans.metric_queries import _fifo_commands

    queues, want = {}, Counter()
    for r in _fifo_commands(spark, sf).orderBy("queue", "idx").collect():
        q = queues.setdefault(r.queue, Plain())
        want.update((r.queue, *x) for x in q.apply(r.idx, r.event, r.pid, r.seqno, r.ids, r.life, r.credit))
    got = Counter(tuple(r) for r in registry.QUERIES["fifo_effects"](spark, sf).collect())
    assert got == want and len({k[2] for k in want}) >= 5
    for r in registry.QUERIES["fifo_overview"](spark, sf).collect():
        q = queues[r.queue]
        assert (r.entered, r.ready, r.checked_out, r.early) == (q.n, len(q.ready), sum(len(s["held"]) for s in q.cons.values()), len(q.early))
        assert r.entered == r.ready + r.checked_out + r.settled + r.dead + r.purged


def test_random_commands(spark):
    rng = random.Random(5)
    events = "enqueue enqueue enqueue checkout settle discard return dequeue cancel purge down noconnection nodeup".split()
    rows = [(q, i, rng.choice(events), rng.randint(0, 3), rng.choice([None, rng.randint(1, 9)]), [rng.randint(0, 5) for _ in range(2)], rng.choice(["auto", "once", "settled", "unsettled"]), rng.randint(1, 3)) for q in range(20) for i in range(150)]
    rows = [r if r[2] != "checkout" or r[6] in ("auto", "once") else (*r[:6], "auto", r[7]) for r in rows]
    want = Counter()
    for q in range(20):
        plain = Plain()
        for r in rows:
            if r[0] == q:
                want.update((q, *x) for x in plain.apply(*r[1:]))
    assert Counter(tuple(r) for r in fifo.effects(run(spark, rows)).collect()) == want
