"""The fold of a batch against a fold of one event after another."""

import random

import pytest

from foliant.operators import history, ingest

FILES = "path string, file_id long, size_bytes long, modified_at_fs long, deleted_epoch long"
EVENTS = "event_id long, ts long, path string, old_path string, event string, size_bytes long, mtime long"


def folder(path):
    return path.rpartition("/")[0]


def one_by_one(files, events):
    """Rows and mutations: each event acts on a dict of rows."""
    rows = {p: {"id": i, "size": s, "mtime": m, "gone": d, "from": p, "known": (s, m, d), "new": False, "acted": False, "ended": None} for p, i, s, m, d in files}
    log = []

    def upsert(path, size, mtime):
        row = rows.get(path)
        kind = "CREATED" if row is None else "RESTORED" if row["gone"] is not None else "MODIFIED"
        if row is None:
            row = rows[path] = {"id": None, "size": None, "mtime": None, "from": None, "known": (None, None, None), "new": True, "ended": None}
        row.update(gone=None, acted=True, size=row["size"] if size is None else size, mtime=row["mtime"] if mtime is None else mtime)
        return kind, row["id"]

    for event_id, ts, path, old, event, size, mtime in sorted(events, key=lambda e: (e[1], e[0])):
        row = rows.get(old)
        if event == "DELETE":
            if path in rows:
                rows[path].update(gone=ts, acted=True, ended=ts)
                log.append((event_id, path, None, rows[path]["id"], "DELETED"))
        elif event == "MOVE" and old not in (None, path) and row and row["gone"] is None:
            if path in rows:
                row.update(gone=ts, acted=True, ended=ts)
                log.append((event_id, old, None, row["id"], "DELETED"))
                log.append((event_id, path, None, *upsert(path, size, mtime)[::-1]))
            else:
                rows[path] = rows.pop(old)
                upsert(path, size, mtime)
                log.append((event_id, path, old, row["id"], "RENAMED" if folder(path) == folder(old) else "MOVED"))
        else:
            log.append((event_id, path, None, *upsert(path, size, mtime)[::-1]))
    net = {}
    for p, r in rows.items():
        if r["gone"] is None:
            kind = None if not r["acted"] else "CREATED" if r["new"] else ("RENAMED" if folder(p) == folder(r["from"]) else "MOVED") if r["from"] != p else "RESTORED" if r["known"][2] is not None else "MODIFIED"
            net[p] = (r["id"], r["size"], r["mtime"], None, kind, r["from"] if r["from"] not in (None, p) else None)
        elif not r["new"]:
            net[p] = (r["id"], *r["known"][:2], r["known"][2] if r["known"][2] is not None else r["ended"], "DELETED" if r["acted"] else None, r["from"] if r["from"] != p else None)
    return net, log


def both(spark, files, events):
    f, e = spark.createDataFrame(files, FILES), spark.createDataFrame(events, EVENTS)
    rows = ingest.apply_events(f, e).collect()
    net = {r.path: (r.file_id, r.size_bytes, r.modified_at_fs, r.deleted_epoch, r.mutation, r.old_path) for r in rows}
    assert len(net) == len(rows)
    log = history.mutations(history.fold(f, e)).collect()
    assert len({r.event_key for r in log}) == len(log)
    return net, sorted((r.event_id, r.path, r.old_path or "", r.file_id or 0, r.mutation) for r in log)


def plain(log):
    return sorted((e, p, o or "", i or 0, m) for e, p, o, i, m in log)


@pytest.mark.parametrize("seed", range(3))
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    files, events = [], []
    for world in range(120):
        names = [f"/w{world}/{d}/{c}" for d in "xy" for c in "abc"]
        files += [(p, world * 10 + k, 5, 5, rnd.choice([None, None, 3])) for k, p in enumerate(names) if rnd.random() < 0.5]
        for k in range(rnd.randint(1, 14)):
            event = rnd.choice(["MOVE", "MOVE", "MOVE", "UPSERT", "DELETE", "CREATE"])
            path, old = rnd.choice(names), rnd.choice([*names, None]) if event == "MOVE" else None
            events.append((world * 100 + k, 100 + rnd.randint(0, 9), path, old, event, rnd.choice([None, k + 10]), rnd.choice([None, k + 20])))
    want, log = one_by_one(files, events)
    got, told = both(spark, files, events + events[::7])
    assert got == want
    assert told == plain(log)


def test_a_thousand_moves_in_a_row_a_cycle_and_a_fork(spark):
    files = [("/c/0", 1, 5, 5, None), ("/r/a", 2, 6, 6, None), ("/r/b", 3, 7, 7, None), ("/f/a", 4, 8, 8, None)]
    events = [(k, k, f"/c/{k + 1}", f"/c/{k}", "MOVE", None, None) for k in range(1000)]
    events += [(2000, 2000, "/r/t", "/r/a", "MOVE", None, None), (2001, 2001, "/r/a", "/r/b", "MOVE", None, None), (2002, 2002, "/r/b", "/r/t", "MOVE", None, None)]  # a and b change places
    events += [(3000, 3000, "/f/b", "/f/a", "MOVE", None, None), (3001, 3001, "/f/a", None, "CREATE", 1, 1), (3002, 3002, "/f/c", "/f/a", "MOVE", None, None)]
    want, log = one_by_one(files, events)
    got, told = both(spark, files, events)
    assert got == want and told == plain(log)
    assert got["/c/1000"][0] == 1 and (got["/r/a"][0], got["/r/b"][0]) == (3, 2) and (got["/f/b"][0], got["/f/c"][0]) == (4, None)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plan_does_not_grow_with_a_chain(spark):
    def applied(n):
        files = spark.createDataFrame([("/c/0", 1, 5, 5, None)], FILES)
        return ingest.apply_events(files, spark.createDataFrame([(k, k, f"/c/{k + 1}", f"/c/{k}", "MOVE", None, None) for k in range(n)], EVENTS))

    assert scans(applied(2)) == scans(applied(64)) <= 4


def test_rows_that_depend_on_rows_that_depend_on_rows(spark):
    """Each move onto a path from which the row before has left or not, 40 deep."""
    files = [("/0", 1, 5, 5, None)] + [(f"/{k}", k + 1, 5, 5, None) for k in range(1, 41)]
    events = [(40 - k, 40 - k, f"/{k + 1}", f"/{k}", "MOVE", None, None) for k in range(40, -1, -1)]
    want, log = one_by_one(files, events)
    got, told = both(spark, files, events)
    assert got == want and told == plain(log)


def test_odd_rows(spark):
    files = [("/a", 1, 5, 5, None), (None, 2, 5, 5, None)]
    events = [(None, None, "/a", None, "UPSERT", 6, 6), (1, 1, None, "/a", "MOVE", 1, 1), (2, 2, "/b", "/b", "MOVE", 1, 1), (3, 3, "/c", None, None, 1, 1), (3, 3, "/c", None, None, 1, 1)]
    got = {r.path: (r.file_id, r.size_bytes, r.mutation) for r in ingest.apply_events(spark.createDataFrame(files, FILES), spark.createDataFrame(events, EVENTS)).collect()}
    assert got == {"/a": (1, 6, "MODIFIED"), None: (2, 5, None), "/b": (None, 1, "CREATED"), "/c": (None, 1, "CREATED")}
    empty = spark.createDataFrame([], EVENTS)
    assert ingest.apply_events(spark.createDataFrame(files, FILES), empty).count() == 2 and history.mutations(history.fold(spark.createDataFrame(files, FILES), empty)).count() == 0
