import hashlib
import random
import re

from twinfold.llm import lines, quotes


def slots_of(text, per=lines.SLOT_WORDS):
    out = []
    for number, line in enumerate((text or "").split("\n")):
        for k in range(-(-len(re.findall(r"[^\x20\x09-\x0D]+", line)) // per)):
            out.append((int(hashlib.md5(f"{line}\0{k}".encode()).hexdigest()[:15], 16), number))
    return out


def expected_lines(docs, w=lines.WINDOW, reach=lines.REACH):
    """Winnowing in plain loops: fingerprints, first holders, extension slot by slot."""
    slots = {i: slots_of(t) for i, t in docs}
    marks = {}
    for i, s in slots.items():
        for a in range(len(s) - w + 1):
            p = min(range(a, a + w), key=lambda q: (s[q][0], -q))
            marks.setdefault(s[p][0], set()).add((i, p))
    gone = {}
    for places in marks.values():
        (fi, fp), *rest = sorted(places)
        for i, p in rest:
            def same(d):
                return 0 <= p + d < len(slots[i]) and 0 <= fp + d < len(slots[fi]) and slots[i][p + d][0] == slots[fi][fp + d][0]
            a = next((d for d in range(1, reach + 1) if not same(-d)), reach + 1) - 1
            b = next((d for d in range(1, reach + 1) if not same(d)), reach + 1) - 1
            if a + b + 1 >= w:
                gone.setdefault(i, set()).update(slots[i][q][1] for q in range(p - a, p + b + 1))
    return gone


def test_repeated_runs(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["red", "blue", "one", "two", "sky"]) for _ in range(rng.choice([1, 3, 8, 30, 70]))) for _ in range(14)]
    docs = [(i, "\n".join(rng.choice([*pool, "", "own %d" % rng.randrange(10**6)]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "x\n" * 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumnsRenamed({"doc_id": "n_lines"})
    got = {r["n_lines"]: set(r["lines"]) for r in lines.repeated_lines(frame, "n_lines").collect()}
    assert got == expected_lines(docs) and got
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lines int, n_removed int")
    for r in lines.without_repeated_lines(frame).collect():
        text = dict(docs)[r.doc_id]
        kept = [x for i, x in enumerate((text or "").split("\n")) if i not in got.get(r.doc_id, ())]
        assert r.text == (text if r.doc_id not in got else "\n".join(kept)) and r.n_removed == len(got.get(r.doc_id, ()))


def expected_runs(docs, w=lines.WINDOW):
    """Every run of ``w`` slots that an earlier place holds, by looking at all windows in order."""
    seen, gone = set(), {}
    for i, text in sorted(docs):
        s = slots_of(text)
        for a in range(len(s) - w + 1):
            key = tuple(h for h, _ in s[a:a + w])
            if key in seen:
                gone.setdefault(i, set()).update(number for _, number in s[a:a + w])
            seen.add(key)
    return gone


def test_runs_of_frequent_lines_go(spark):
    rng = random.Random(3)
    hot = min(("hot %d" % k for k in range(50)), key=lambda x: slots_of(x)[0][0])  # the fingerprint wherever it stands
    docs = [(0, f"x\n{hot}\ny"), (1, f"M\n{hot}\nN"), (2, f"M\n{hot}\nN")]
    docs += [(i, "\n".join(rng.choice([hot, "a", "b", "", "c " * 60, "own %d" % rng.randrange(10**6)]) for _ in range(rng.randint(0, 12)))) for i in range(3, 80)]
    docs += [(500, None), (501, "\n\n"), (502, "x\n" * 100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: set(r.lines) for r in lines.repeated_runs(frame).collect()}
    assert got[2] == {0, 1, 2} and 1 not in got and got == expected_runs(docs)
    assert expected_lines(docs[:3]) == {}  # what the first holder of the single slot finds there
    kept = {r.doc_id: (r.text, r.n_removed) for r in lines.without_repeated_lines(frame, runs=True).filter("doc_id < 3").collect()}
    assert kept == {0: (docs[0][1], 0), 1: (docs[1][1], 0), 2: ("", 3)}


def test_planted_passages_go_and_the_first_stays(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("%06x" % rng.randrange(16**6) for _ in range(n))
    long_line, block = words(60), "\n".join(words(9) for _ in range(8))
    docs = [(i, "\n".join([words(20), rng.choice([long_line, block]), words(20)])) for i in range(40)]
    got = [r.text for r in lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()]
    assert sum(long_line in t for t in got) == 1 and sum(block in t for t in got) == 1
    assert all(line not in t or t.count(line) == 1 for line in block.split("\n") for t in got)
    assert sum(block.split("\n")[0] in t for t in got) == 1 and all(len(t.split()) >= 40 for t in got)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lines int")
    assert lines.without_repeated_lines(empty).collect() == []


MESSAGES = [
    (1, 0, "user", "How do I open the file?\nIt is on the disk."),
    (1, 1, "assistant", "Use open.\n\nThen read it."),
    (1, 2, "user", "> Use  OPEN.\n\nIt fails."),
    (1, 3, "assistant", "> > Use open.\n> It fails.\nWith what message?"),
    (1, 4, "user", ">How do I open the file?\n>It is on the disk.\nAnother way?\n> unknown text"),
    (1, 5, "user", "> With what message?\nNo such file."),
    (2, 0, "user", "> Use open.\nquoting another conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 0, "user", "alone"),
    (None, 1, "user", "> alone\nreply"),
    (3, None, "user", "> alone"),
]


def test_replies(spark):
    frame = spark.createDataFrame([(*m, "x", "y") for m in MESSAGES], "conv_id long, turn long, role string, text string, thread string, holder string")
    rows = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    assert len(rows) == len(MESSAGES)
    reply = {k: r.reply_to for k, r in rows.items() if r.reply_to is not None}
    assert reply == {(1, 2): 1, (1, 3): 2, (1, 4): 0, (1, 5): 3, (None, 1): 0}
    assert [rows[1, t].thread for t in range(6)] == [0, 1, 1, 1, 0, 1]
    assert sorted(range(6), key=lambda t: rows[1, t].position) == [0, 4, 1, 2, 3, 5]
    assert sorted(r.position for k, r in rows.items() if k[0] == 2) == [0, 1, 2]
    assert rows[1, 3].body == "With what message?" and rows[1, 4].body == "Another way?" and rows[2, 1].body == ""
    assert (rows[1, 3].n_quotes, rows[1, 3].n_linked) == (2, 2) and (rows[1, 4].n_quotes, rows[1, 4].n_linked) == (2, 1)


def test_the_holder_of_most_lines_is_quoted(spark):
    rng = random.Random(5)
    talks = {1: ["Thanks.", "Use open.\nThanks.\nBye.", "> Use open.\n> Thanks.\nSo?"]}
    for c in (2, 3):  # few words: most lines have many holders
        talks[c] = []
        for t in range(60):
            own = [rng.choice(["yes", "no", "ok", "well", "bye", "own %d" % t]) for _ in range(rng.randint(1, 4))]
            cited = rng.choice(talks[c]).split("\n") if t else []
            cited = rng.sample(cited, rng.randint(0, len(cited))) if c == 3 else cited[:rng.randint(0, 3)]
            talks[c].append("\n".join(["> " + x for x in cited if not x.startswith(">")] + own))
    want = {}
    for c, texts in talks.items():
        own = [[x for x in t.split("\n") if not x.startswith(">")] for t in texts]
        holds = [{*o, " ".join(o)} for o in own]
        for t, text in enumerate(texts):
            cited = [x[2:] for x in text.split("\n") if x.startswith("> ")]
            units = {*cited, " ".join(cited)} - {""}
            ranks = [(" ".join(cited) in holds[h], len(units & holds[h]), -h) for h in range(t)]
            best = max(ranks, default=(0, 0, 0))
            want[c, t] = -best[2] if best[1] else None
    frame = spark.createDataFrame([(c, t, "user", x) for c, texts in talks.items() for t, x in enumerate(texts)],
                                  "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.link_quotes(frame).collect()}
    assert got[1, 2] == 1 and got == want


def test_a_common_line_makes_no_pairs(spark):
    frame = spark.createDataFrame([(1, t, "user", "yes" if t % 2 else "> yes\nmore %d" % t) for t in range(300)],
                                  "conv_id long, turn long, role string, text string")
    rows = quotes.link_quotes(frame).collect()
    assert len(rows) == 300 and {r.reply_to for r in rows} == {None, 1}


def test_no_messages_and_repeated_rows(spark):
    schema = "conv_id long, turn long, role string, text string, unit int"
    assert quotes.link_quotes(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, 1, "user", "> a", 1)], schema)
    rows = quotes.link_quotes(twice).collect()
    assert len(rows) == 3 and [r.reply_to for r in rows if r.turn == 1] == [0]
