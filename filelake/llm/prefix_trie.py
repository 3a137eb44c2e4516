"""Prefix tries of conversations: double arrays per prefix shard, merged where shards share upper nodes.

A turn is an item of ITEM bytes: the md5 of its role and text and its number of words. A conversation's path is
its items joined, so that paths in binary order are the tree in preorder. A shard is a run of sorted distinct
paths of at most about SHARD_TURNS turns; only prefixes of its first and last path can go on in another shard. All
other nodes are settled within the shard; those two spines carry what hangs below them into the merge, whose rounds
join the spines of 2**FAN_LOG2 tasks at a time, so no task ever sees more than they.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, prepare, written

ITEM, SHARD_TURNS, FAN_LOG2 = 20, 1 << 16, 6
#: conv_ids that one row joins on the way to the digest of a node's ends; free slots tried for a node's children.
PIECE_IDS, TRIES = 8192, 64
FREE, ROOT = -2, -1
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
#: What a node has of its own and of settled nodes below it.
HELD = np.dtype([("convs", "<i8"), ("conv", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8"), ("ends", "S64")])

_PIECES = "path binary, part long, no long, n long, conv long, ids string"
_SHARDS = "part long, no long, items binary, base binary, check binary, ends binary, first binary, last binary"
_NODES = "conv_id long, depth long, node_key binary, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SPINES = "part long, no long, side int, path binary, skip int, held binary"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_ENDS = np.dtype([("slot", "<i4"), ("n", "<i8"), ("conv", "<i8"), ("sha", "S64")])


def turn_items(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), item (hexadecimal): turns in order, null turn first, ties by role and text. Null role
    or text is empty; rows of null conv_id take no part; repeated rows are turns of their own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.upper(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    words = F.lpad(F.hex(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 8, "0")
    return plain.select("conv_id", place.cast("long").alias("pos"), F.concat(digest, words).alias("item"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path of turns (conv_id, pos, item). A row of null item makes a conversation known, turns or not."""
    inner = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("pos", "item"))))
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(inner, lambda x: x["item"]), "")).alias("path"))


def _batch(ddl: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, conv_id): the ids of one path as rows of at most PIECE_IDS of them."""
    part, no, path, ids = TaskContext.get().partitionId(), 0, None, []

    def row():
        return (path, part, no, len(ids), ids[0], ",".join(map(str, ids)))

    for batch in bounded(batches):
        out = []
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (p != path or len(ids) == PIECE_IDS):
                out.append(row())
                no, ids = no + 1, []
            path = p
            ids.append(c)
        if out:
            yield _batch(_PIECES, list(zip(*out, strict=True)))
    if ids:
        yield _batch(_PIECES, [[x] for x in row()])


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common."""
    n, d = min(len(a), len(b)), 0
    while d < n and a[d : d + ITEM] == b[d : d + ITEM]:
        d += ITEM
    return min(d, n) // ITEM


def double_array(sorted_paths: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items, base, check, slot of each path's end). A turn's dense id is its place in items, from 1; the child of
    slot s by id c is slot base[s] + c, if check there is s. The root is slot 0."""
    parent, at, depth, ends, stack, before = [], [], [], [], [0], b""
    for k, path in enumerate(sorted_paths):
        same = _common(before, path)
        del stack[same + 1 :]
        for d in range(same, len(path) // ITEM):
            parent.append(stack[-1])
            at.append((k, d))
            depth.append(d)
            stack.append(len(parent))
        ends.append(stack[-1])
        before = path
    n = len(parent)
    if not n:
        return np.zeros(0, f"S{ITEM}"), np.zeros(1, np.int32), np.full(1, ROOT, np.int32), np.zeros(len(ends), np.int64)
    item = np.array([sorted_paths[k][d * ITEM : (d + 1) * ITEM] for k, d in at], f"S{ITEM}")
    by_depth = np.argsort(depth, kind="stable")  # siblings mostly get neighbouring ids
    distinct, first, inverse = np.unique(item[by_depth], return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(1, len(distinct) + 1)
    code = np.empty(n, np.int64)
    code[by_depth] = rank[inverse]
    items = np.empty(len(distinct), f"S{ITEM}")
    items[rank - 1] = distinct

    parent = np.array(parent)
    order = np.lexsort((code, parent))
    owner, start = np.unique(parent[order], return_index=True)
    stop = np.append(start[1:], n)
    room = np.full(2 * (n + len(items)) + 2, FREE, np.int32)
    room[0] = ROOT
    slot = np.zeros(n + 1, np.int64)  # of each node; nodes count from 1
    base_of = np.zeros(n + 1, np.int64)
    top, low = 1, 1
    several = np.flatnonzero(stop - start > 1)
    for g in several[np.argsort(start[several] - stop[several], kind="stable")]:
        nodes = order[start[g] : stop[g]]
        codes = code[nodes]
        away = codes - codes[0]
        if top + away[-1] + 1 + 2 * TRIES > len(room):
            room = np.append(room, np.full(len(room) + away[-1] + 2 * TRIES, FREE, np.int32))
        tried = low + np.flatnonzero(room[low : low + 4 * TRIES] == FREE)[:TRIES]
        fits = (room[np.minimum(tried[:, None] + away, len(room) - 1)] == FREE).all(axis=1) & (tried + away[-1] < len(room))
        to = int(tried[fits.argmax()]) if fits.any() else top
        room[to + away] = 0  # taken; its owner's slot follows below
        slot[nodes + 1], base_of[owner[g]] = to + away, to - codes[0]
        top = max(top, to + away[-1] + 1)
        if not fits.any():  # what lies below is crowded
            low = max(low, top - TRIES)
    single = np.flatnonzero(stop - start == 1)
    free = np.flatnonzero(room[:top] == FREE)[: len(single)]
    free = np.append(free, np.arange(top, top + len(single) - len(free)))
    nodes = order[start[single]]
    slot[nodes + 1], base_of[owner[single]] = free, free - code[nodes]
    size = int(slot.max()) + 1
    base, check = np.zeros(size, np.int32), np.full(size, FREE, np.int32)
    base[slot], check[0] = base_of, ROOT
    check[slot[1:]] = slot[parent]
    return items, base, check, slot[np.array(ends, np.int64)]


def walk(items: np.ndarray, base: np.ndarray, check: np.ndarray, path: bytes) -> list[int]:
    """Slots from the root along a path, as far as the trie has it."""
    order = np.argsort(items)
    wanted = np.frombuffer(path, f"S{ITEM}")
    found = np.searchsorted(items, wanted, sorter=order) if len(items) else np.zeros(len(wanted), np.int64)
    out = [0]
    for w, f in zip(wanted, found, strict=True):
        if f == len(items) or items[order[f]] != w:
            break
        t = int(base[out[-1]]) + int(order[f]) + 1
        if not 0 < t < len(check) or check[t] != out[-1]:
            break
        out.append(t)
    return out


def _pack(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted pieces to double arrays; a shard ends between paths."""
        part, no, turns = TaskContext.get().partitionId(), 0, 0
        held: list = []  # path, ids, least id, running digest

        def shard():
            nonlocal no, turns
            items, base, check, slots = double_array([x[0] for x in held])
            ends = np.zeros(len(held), _ENDS)
            ends["slot"], ends["n"], ends["conv"] = slots, [x[1] for x in held], [x[2] for x in held]
            ends["sha"] = [x[3].hexdigest().encode() for x in held]
            row = (part, no, items.tobytes(), base.tobytes(), check.tobytes(), ends.tobytes(), held[0][0], held[-1][0])
            no, turns = no + 1, 0
            held.clear()
            return _batch(_SHARDS, [[x] for x in row])

        for batch in bounded(batches):
            for row in batch.to_pylist():
                if held and row["path"] == held[-1][0]:
                    held[-1][1] += row["n"]
                    held[-1][3].update(b"," + row["ids"].encode())
                    continue
                if turns >= shard_turns:
                    yield shard()
                held.append([row["path"], row["n"], row["conv"], hashlib.sha256(row["ids"].encode())])
                turns += 1 + len(row["path"]) // ITEM
        if held:
            yield shard()

    return run


def pack_tries(conversation_paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The written table of double arrays, a row a shard. Copies of a conversation are joined before they meet: tasks
    of a range of (path, conv_id) write their ids as pieces, so a path that a third of all conversations share
    reaches its shard as one row for PIECE_IDS of them."""
    prepare(conversation_paths.sparkSession)
    kept = written(conversation_paths.select("path", "conv_id"), "paths")
    dealt = kept.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = written(dealt.mapInArrow(_pieces, _PIECES), "pieces")
    dealt = pieces.repartitionByRange("path").sortWithinPartitions("path", "part", "no")
    return written(dealt.mapInArrow(_pack(shard_turns), _SHARDS), "tries")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["items"], f"S{ITEM}"),
        np.frombuffer(row["base"], np.int32),
        np.frombuffer(row["check"], np.int32),
        np.frombuffer(row["ends"], _ENDS),
    )


def _keys(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, the empty one first."""
    h = hashlib.md5()
    out = [h.copy().digest()]
    for i in range(0, len(path), ITEM):
        h.update(path[i : i + ITEM])
        out.append(h.copy().digest())
    return out


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard, level by level over BASE and CHECK; settled ones as rows, the spines as two more."""
    blank = [None] * 10
    for batch in bounded(batches, 1):
        for row in batch.to_pylist():
            items, base, check, ends = _unpacked(row)
            used = np.flatnonzero(check >= 0)
            kids = used[np.argsort(check[used], kind="stable")]
            start = np.searchsorted(check[kids], np.arange(len(check) + 1))
            depth, levels = np.zeros(len(check), np.int64), [np.zeros(1, np.int64)]
            while len(levels[-1]):
                s = levels[-1]
                many = start[s + 1] - start[s]
                here = np.repeat(start[s] - np.cumsum(many) + many, many) + np.arange(many.sum())
                levels.append(kids[here])
                depth[levels[-1]] = len(levels) - 1
            held = np.zeros(len(check), HELD)
            held["conv"] = NONE
            held["convs"][ends["slot"]], held["conv"][ends["slot"]], held["ends"][ends["slot"]] = ends["n"], ends["conv"], ends["sha"]
            words = np.zeros(len(check), np.int64)
            raw = np.frombuffer(row["items"], np.uint8).reshape(-1, ITEM)[:, ITEM - 4 :].astype(np.int64)
            words[used] = (raw @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))[used - base[check[used]] - 1]
            first, last = walk(items, base, check, row["first"]), walk(items, base, check, row["last"])
            is_open = np.zeros(len(check), bool)
            is_open[first], is_open[last] = True, True
            for level in levels[:0:-1]:
                s = level[~is_open[level]]
                if not len(s):
                    continue
                up = check[s]
                held["leaves"][s] += held["children"][s] == 0
                held["saved"][s] += (held["convs"][s] - 1) * words[s]
                for name in ("convs", "leaves", "saved"):
                    np.add.at(held[name], up, held[name][s])
                np.add.at(held["children"], up, 1)
                np.minimum.at(held["conv"], up, held["conv"][s])
            s = used[~is_open[used]]
            up = check[s]
            key = dict(zip(first, _keys(row["first"]), strict=True)) | dict(zip(last, _keys(row["last"]), strict=True))
            hangs = is_open[up]
            sha = np.where(held["ends"][s] == b"", EMPTY.encode(), held["ends"][s])
            for i in range(0, len(s), 1 << 14):
                j = slice(i, i + (1 << 14))
                own = held[s[j]]
                over = held["conv"][up[j]]
                columns = [own["conv"], depth[s[j]], [None] * len(own), [key[u] if h else None for u, h in zip(up[j], hangs[j], strict=True)]]
                columns += [pa.array(over, mask=hangs[j]), own["convs"], own["children"], own["leaves"], own["saved"], sha[j].astype(str)]
                columns += [[None] * len(own)] * 6
                yield _batch(f"{_NODES}, {_SPINES}", columns)
            same = _common(row["first"], row["last"])
            spines = [(0, row["first"], 0, held[first])] + [(1, row["last"], same + 1, held[last][same + 1 :])] * (row["first"] != row["last"])
            for side, path, skip, own in spines:
                yield _batch(f"{_NODES}, {_SPINES}", [[x] for x in (*blank, row["part"], row["no"], side, path, skip, own.tobytes())])


def _merge(last_round: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sorted spines of neighbouring tasks as one: a node is settled when the next path leaves it, unless it lies
        on the first path, which may go on before, or on the last, which may go on behind."""
        rows = pdf.sort_values(["part", "no", "side"]).to_dict("records")
        names = [x.split()[0] for x in f"{_NODES}, {_SPINES}".split(", ")]
        out: list[dict] = []
        opening = rows[0]["path"]
        kept: dict[int, np.ndarray] = {}  # of the first path, left by the scan
        stack: list[np.ndarray] = []
        keys, path = [], b""

        def leave(depth: int) -> None:
            own = stack.pop()
            if not last_round and depth <= len(opening) // ITEM and path[: depth * ITEM] == opening[: depth * ITEM]:
                kept[depth] = own
                return
            here = own[0]
            here["leaves"] += here["children"] == 0
            if depth:
                here["saved"] += (here["convs"] - 1) * int.from_bytes(path[depth * ITEM - 4 : depth * ITEM], "big")
                up = stack[-1][0]
                for name in ("convs", "leaves", "saved"):
                    up[name] += here[name]
                up["children"] += 1
                up["conv"] = min(up["conv"], here["conv"])
            out.append(
                {
                    "conv_id": int(here["conv"]),
                    "depth": depth,
                    "node_key": keys[depth],
                    "parent_key": keys[depth - 1] if depth else None,
                    "n_convs": int(here["convs"]),
                    "n_children": int(here["children"]),
                    "n_leaves": int(here["leaves"]),
                    "saved_tokens": int(here["saved"]),
                    "ends_sha256": here["ends"].decode() or EMPTY,
                }
            )

        for row in rows:
            same = _common(path, row["path"])
            while len(stack) > same + 1:
                leave(len(stack) - 1)
            path, keys = row["path"], _keys(row["path"])
            for depth, own in enumerate(np.frombuffer(row["held"], HELD), row["skip"]):
                if depth == len(stack):
                    stack.append(np.array([own]))
                    continue
                up = stack[depth][0]
                for name in ("convs", "children", "leaves", "saved"):
                    up[name] += own[name]
                up["conv"] = min(up["conv"], own["conv"])
                if own["ends"]:
                    up["ends"] = own["ends"]
        if last_round:
            while stack:
                leave(len(stack) - 1)
        else:
            same = _common(opening, path)
            front = [(stack[d] if d in range(same + 1) else kept[d])[0] for d in range(len(opening) // ITEM + 1)]
            place = {k: rows[0][k] for k in ("part", "no")}
            out.append(place | {"side": 0, "path": opening, "skip": 0, "held": np.array(front, HELD).tobytes()})
            if path != opening:
                out.append(place | {"side": 1, "path": path, "skip": same + 1, "held": np.array([x[0] for x in stack[same + 1 :]], HELD).tobytes()})
        return pd.DataFrame(out, columns=names, dtype=object)

    return run


def trie_nodes(tries: DataFrame) -> DataFrame:
    """One row per distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No conversations, no nodes."""
    prepare(tries.sparkSession)
    ddl = f"{_NODES}, {_SPINES}"
    tables = [written(tries.mapInArrow(_traverse, ddl), "nodes")]
    tasks = (tries.agg(F.max("part")).first()[0] or 0) + 1
    shift, last_round = 0, False
    while not last_round:
        shift += FAN_LOG2
        last_round = tasks <= 1 << shift
        spines = tables[-1].where("side is not null")
        tables.append(written(spines.groupBy(F.shiftright("part", shift)).applyInPandas(_merge(last_round), ddl), "merged"))
    nodes = tables[0].where("side is null")
    for t in tables[1:]:
        nodes = nodes.unionByName(t.where("side is null"))
    merged = tables[1].where("node_key is not null")
    for t in tables[2:]:
        merged = merged.unionByName(t.where("node_key is not null"))
    known = merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("found"))
    settled = nodes.where("parent_key is null").select(*_COLUMNS)
    hanging = nodes.where("parent_key is not null").join(known, "parent_key").withColumn("parent_conv_id", F.col("found"))
    return settled.unionByName(hanging.select(*_COLUMNS))


def count_prefix(tries: DataFrame, turns: list[tuple[str, str]]) -> int:
    """Conversations that start with the given (role, text) turns, by walking BASE and CHECK of each shard and summing
    the ends below. Shards whose range of paths cannot hold the prefix are filtered out before."""
    items = []
    for role, text in turns:
        words = len([w for w in text.translate({c: 32 for c in range(9, 14)}).split(" ") if w])
        items.append(hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + words.to_bytes(4, "big"))
    path = b"".join(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            for row in batch.to_pylist():
                names, base, check, ends = _unpacked(row)
                found = walk(names, base, check, path)
                total = 0
                if len(found) == len(items) + 1:
                    at, alive = ends["slot"].astype(np.int64), np.ones(len(ends), bool)
                    below = at == found[-1]
                    while alive.any():
                        at = np.where(alive, check[at], at)
                        alive &= at >= 0
                        below |= alive & (at == found[-1])
                        at = np.maximum(at, 0)
                        alive &= ~below
                    total = int(ends["n"][below].sum())
                yield _batch("n long", [[total]])

    near = tries.where((F.col("last") >= F.lit(path)) & (F.substring("first", 1, len(path)) <= F.lit(path)))
    return near.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
