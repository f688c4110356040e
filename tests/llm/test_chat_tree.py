import random

from hypothesis import given, settings, strategies as st

from subsidia.llm import chat_tree
from tests.compare import connection, same

KIND = "conv_id long, turn long, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<>/turn \nassistant#a🙂"), st.text())
def test_turns_come_back(role, text):
    formatted, lo, hi = chat_tree.format_turn(role, text)
    assert chat_tree.parse_turn(formatted) == (role, text)
    one = chat_tree.format_turn("assistant", text)
    assert chat_tree.unescape(one[0][one[1] : one[2]]) == text and (role == "assistant" or lo is None)


def made():
    rnd = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {rnd.randint(0, 1 + t)}"))
    return rows


def test_tree_emits_shared_turns_once_and_attends_to_its_branch(spark):
    rows = made()
    nodes, paths = chat_tree.chat_tree(spark.createDataFrame(rows, KIND))
    nodes, paths = [r.asDict(recursive=True) for r in nodes.collect()], paths.collect()
    by = {r["node"]: r for r in nodes}
    assert len(by) == len(nodes) == len({p.node for p in paths})
    # depth first: each node comes after its parent, and the nodes below it follow without a gap
    place = {r["node"]: i for i, r in enumerate(nodes)}
    children = {}
    for r in nodes:
        children.setdefault(r["parent"], []).append(r["node"])
    size = {}
    for r in reversed(nodes):
        size[r["node"]] = 1 + sum(size[c] for c in children.get(r["node"], ()))
    for r in nodes:
        at = place[r["node"]] + 1
        for c in sorted(children.get(r["node"], ()), key=place.get):
            assert place[c] == at
            at += size[c]
    # the branches' texts at the positions a node attends to, then its own, are its conversation so far
    text = {}
    for r in nodes:
        text.setdefault(r["branch"], {})[r["start"]] = r["formatted"]
    for r in nodes:
        before, up = "", r["parent"]
        while up:
            before, up = by[up]["formatted"] + before, by[up]["parent"]
        read, at = "", 0
        for a in r["attends"]:
            assert a["from"] == at
            own = text[a["branch"]]
            first = min(own)
            joined = "".join(own[k] for k in sorted(own))
            read += joined[a["from"] - first : a["to"] - first]
            at = a["to"]
        assert read == before and r["start"] == len(before) and r["n_tokens"] == len(r["formatted"])


def test_edges_equal_sql(spark, tmp_path):
    rows = made() + [(100, None, None, None), (100, 1, "assistant", None), (101, 5, "assistant", ""), (None, 1, "user", "gone"), (102, 0, "user", "<turn user>\\"), (102, 0, "user", "<turn user>\\"), (103, 0, "x" * 5000, "y" * 100_000), (104, 0, "assistant", "</turn>\n\\<")]
    df = spark.createDataFrame(rows, KIND)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = connection(str(tmp_path))
    same(chat_tree.read_back(*chat_tree.chat_tree(df.selectExpr("*", "1 AS node", "2 AS depth", "3 AS branch"))), con, chat_tree.chat_sql())
    nodes, paths = chat_tree.chat_tree(df.limit(0))
    assert nodes.count() == paths.count() == chat_tree.read_back(nodes, paths).count() == 0
