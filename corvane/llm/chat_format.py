"""Chat formatting as a prefix tree: turns that conversations share at their start are emitted once, depth first.

Each conversation is a path of nodes; a node's key is the hash of the turns down to it. Conversations are range-sorted
by their paths, which is the depth-first order of the tree, so a task walks them one after another and emits
only the nodes that the conversation before didn't have. Packs are cut at conversation ends once they hold pack_tokens;
a pack repeats the ancestors of its first conversation, so each stands alone. A first turn that a third of all
conversations share is thus spread over tasks like any other, and no tree is ever gathered.

A pack holds token ids, one position id per token (its distance from the root along its own branch, so a branch does
not see its siblings' tokens) and per node the intervals of its ancestors in the pack, to which attention is allowed
besides the node's own tokens before. Assistant texts are the loss spans.

The template is `<turn "role">`, a line end, the text, `</turn>` and a line end; inside texts a backslash before
control strings makes them plain (`\\` for itself, `\\<turn`, `\\</turn`), and `unescape` undoes it. Null roles and texts
are empty. Turns with equal numbers are ordered by role and text; null numbers come first; repeated rows are turns of
their own. Conversations with a null id form one. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written

PATHS = "conv_id long, path array<binary>, roles array<string>, texts array<string>"
NODE = "struct<parent:int,first_token:int,n_tokens:int,position:int,loss_first:int,loss_tokens:int,ancestors:array<struct<first:int,last:int>>>"
PACKS = f"token_ids array<int>, position_ids array<int>, nodes array<{NODE}>, conversations array<struct<conv_id:long,leaf:int>>"
_NODE_TYPE = pa.struct([("parent", pa.int32()), ("first_token", pa.int32()), ("n_tokens", pa.int32()), ("position", pa.int32()), ("loss_first", pa.int32()), ("loss_tokens", pa.int32()), ("ancestors", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
_PACK_SCHEMA = pa.schema([("token_ids", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE_TYPE)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])
#: A pack is a row of half a megabyte; Parquet's row groups are held whole where they are written and read, so they get some 50 packs instead of several hundred.
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 8, "parquet.page.size.row.check.min": 8}
#: Conversations that go to Python at once where packs are made; by default it is 10,000.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
# Bytes of texts that a task gives at once.
_GIVEN = 4 << 20
_TURN = re.compile(r'<turn ("(?:[^"\\]|\\.)*")>\n')
_TOKENIZERS: dict[str, object] = {}


def escape(text: str) -> str:
    """text with no control string left in it."""
    return re.sub(r"\\|<(?=/?turn)", r"\\\g<0>", text)


def unescape(text: str) -> str:
    """What `escape` was given."""
    return re.sub(r"\\([\\<])", r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Opening, escaped text and end of a formatted turn."""
    return f"<turn {json.dumps(role, ensure_ascii=False)}>\n", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        end = formatted.find("</turn>\n", m.end()) if m else -1
        while end > 0 and _escaped(formatted, end, m.end()):
            end = formatted.find("</turn>\n", end + 1)
        if not m or end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((json.loads(m[1]), unescape(formatted[m.end():end])))
        at = end + len("</turn>\n")
    return out


def _escaped(s: str, at: int, low: int) -> bool:
    n = 0
    while at - n > low and s[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, turns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        paths, roles, texts = [], [], []
        for rows in turns:
            key, path = b"", []
            for t in rows:
                role, text = (t["role"] or "").encode(), (t["text"] or "").encode()
                key = hashlib.sha256(key + len(role).to_bytes(8, "big") + role + text).digest()[:16]
                path.append(key)
            paths.append(path)
            roles.append([t["role"] or "" for t in rows])
            texts.append([t["text"] or "" for t in rows])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.binary())), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], names=["conv_id", "path", "roles", "texts"])


class _Pack:
    def __init__(self):
        self.ids, self.positions, self.nodes, self.conversations, self.keys = [], [], [], [], []

    def add(self, path: list[bytes], encoded: list[tuple], conv_id) -> None:
        """Nodes that the conversation before in this pack doesn't share, then the conversation's end."""
        shared = 0
        stack = self.keys
        while shared < min(len(stack), len(path)) and stack[shared][0] == path[shared]:
            shared += 1
        del stack[shared:]
        for depth in range(shared, len(path)):
            opening, body, end, loss = encoded[depth]
            first, parent = len(self.ids), stack[-1][1] if stack else -1
            up = self.nodes[parent] if stack else None
            position = up["position"] + up["n_tokens"] if up else 0
            above = [*up["ancestors"], {"first": up["first_token"], "last": up["first_token"] + up["n_tokens"] - 1}] if up else []
            if len(above) > 1 and above[-2]["last"] + 1 == above[-1]["first"]:
                above[-2:] = [{"first": above[-2]["first"], "last": above[-1]["last"]}]
            ids = opening + body + end
            self.ids += ids
            self.positions += range(position, position + len(ids))
            self.nodes.append({"parent": parent, "first_token": first, "n_tokens": len(ids), "position": position, "loss_first": first + len(opening) if loss else -1, "loss_tokens": len(body) if loss else 0, "ancestors": above})
            stack.append((path[depth], len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "leaf": stack[-1][1] if stack else -1})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((self.ids, self.positions, self.nodes, self.conversations), _PACK_SCHEMA, strict=True)], schema=_PACK_SCHEMA)


def _packer(tokenizer: str, loss_role: str, pack_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now = _tokenizer(tokenizer), _Pack()
        before: dict[bytes, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                new = {k: (r, x) for row in rows for k, r, x in zip(row["path"], row["roles"], row["texts"], strict=True) if k not in before}
                parts = [p for r, x in new.values() for p in turn_parts(r, x)]
                ids = [e.ids for e in t.encode_batch_fast(parts, add_special_tokens=False)]
                known = before | {k: (*ids[3 * i:3 * i + 3], r == loss_role) for i, (k, (r, _)) in enumerate(new.items())}
                for row in rows:
                    now.add(row["path"], [known[k] for k in row["path"]], row["conv_id"])
                    if len(now.ids) >= pack_tokens or len(now.conversations) >= pack_tokens:
                        yield now.batch()
                        now = _Pack()
                before = {k: known[k] for k in rows[-1]["path"]}
        if now.conversations:
            yield now.batch()

    return pack


def pack_conversations(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant", pack_tokens: int = 65_536) -> DataFrame:
    """Packs of all conversations, written once to the shared folder: token_ids, position_ids, nodes, conversations."""
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    paths = whole.mapInArrow(_paths, PATHS).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return written(paths.mapInArrow(_packer(tokenizer, loss_role, pack_tokens), PACKS), "packs", ROW_GROUPS, BATCHES)


READ = "conv_id long, formatted string, roles array<string>, texts array<string>, loss_text string"


def read_packs(packs: DataFrame, tokenizer: str) -> DataFrame:
    """Each conversation as its pack has it: formatted text, roles, texts and all text under the loss mask, unescaped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, parent, first, size, loss_first, loss_size, conversations = (batch.column(i)[k].as_py() for i in range(7))
                spans = [ids[at:at + n] for at, n in zip(first, size, strict=True)] + [ids[at:at + n] if n else [] for at, n in zip(loss_first, loss_size, strict=True)]
                plain = t.decode_batch(spans, skip_special_tokens=False)
                out, held = [], 0
                for c in conversations:
                    chain, at = [], c["leaf"]
                    while at >= 0:
                        chain.append(at)
                        at = parent[at]
                    chain.reverse()
                    formatted = "".join(plain[n] for n in chain)
                    pairs = parse(formatted)
                    out.append((c["conv_id"], formatted, [r for r, _ in pairs], [x for _, x in pairs], "".join(unescape(plain[len(parent) + n]) for n in chain)))
                    # a turn that conversations share is once in the pack but in each of their texts
                    held += 3 * len(formatted)
                    if held > _GIVEN or len(out) == 200:
                        yield given(out)
                        out, held = [], 0
                if out:
                    yield given(out)

    def given(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "formatted", "roles", "texts", "loss_text"])

    # positions and ancestors aren't needed to read texts, and are more than half of a pack
    needed = packs.select("token_ids", *[F.col(f"nodes.{n}").alias(n) for n in ("parent", "first_token", "n_tokens", "loss_first", "loss_tokens")], "conversations")
    return needed.mapInArrow(read, READ)
