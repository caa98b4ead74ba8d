import hashlib
import zlib
from collections import defaultdict

from docflow.llm import prefixtrie

KIND = "conv_id long, turn long, role string, text string, depth string, p1 string, value string, stretch string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], KIND)


def plain(rows, share=True):
    """The contract read plainly over all sequences, in Python."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if share else 0
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, found in members.items():
        tree, open_ = [], [k]
        while open_:
            tree.append(open_.pop())
            open_ += children[tree[-1]]
        ends = sorted(c for c in found if len(whole[c]) == len(k))
        out.append((
            min(found), len(k), min(members[k[:-1]]) if k else None, len(found), len(children[k]), sum(not children[x] for x in tree),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in tree if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def shown(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def rebuilt(spark, rows):
    return prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie._turns(table(spark, rows))))


def test_rebuilt_conversations_against_plain_sequences(spark):
    texts = ("one", "two", "three 😀 日本", "", None)
    rows = []
    for c in [*range(60), *range(95, 140), 300, 301, 450, 7_000_000_042]:
        for t in range((c * 7) % 9):
            rows.append((c, None if (c + t) % 17 == 0 else t, ("user", "assistant", None)[(c % 4 + t) % 3], texts[(c // 25 + t * (c % 3)) % 5]))
    rows += [(None, 1, "user", "no id"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "user", "other"), (6, 0, "user", "x" * 100_000)]
    assert shown(rebuilt(spark, rows)) == plain(rows)


def test_equal_and_nested_conversations(spark):
    """A caterpillar: each conversation leaves the one before a turn later; copies; prefixes that end inside another."""
    spine = [("user", f"turn {i}") for i in range(12)]
    every = [spine[:i] + [("assistant", f"leaves at {i}")] for i in range(12)] + [spine] * 5 + [spine[:4], spine[:4], spine[:7]]
    rows = [(1000 + c, t, *turn) for c, turns in enumerate(every) for t, turn in enumerate(turns)]
    assert shown(prefixtrie.conversation_trie(table(spark, rows))) == plain(rows, share=False)


def test_turnless_conversations_end_at_the_root(spark):
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(alone, 0, "user", "taken away")]
    assert shown(rebuilt(spark, rows)) == plain(rows)
    assert plain(rows)[0][1:3] == (0, None)


def test_many_members_at_one_node(spark):
    rows = [(c * 3, 0, "user", "same") for c in range(9000)]
    assert shown(prefixtrie.conversation_trie(table(spark, rows))) == plain(rows, share=False)


def test_no_rows(spark):
    assert prefixtrie.conversation_trie(table(spark, [(1, 1, "u", "x")]).limit(0)).count() == 0
