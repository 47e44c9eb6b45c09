"""Allocation, splits, mirrors, processed samples, builds, audits, absorbed texts, word runs and split files against plain definitions."""

import gzip
import math
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import kernels, markup, matching
from sparrowmill.operators import absorbed, allocation, audits, ngrams, samples, trees, weights
from sparrowmill.plans import catalog
from sparrowmill.sources import builds, tfrecord

SF = "/root/testdata/sf0.001"


def test_joint_samples_keep_their_quotas(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("aaabbc"), rng.randrange(9), rng.random() < 0.3) for k in range(400)]
    stock = spark.createDataFrame(rows, "key bigint, kind string, episode int, answer boolean")
    more = spark.createDataFrame([(k,) for k in range(1000, 1040)], "key bigint")
    found, report = allocation.joint_samples(stock, "key", "kind", "episode", (60, 90), "3", ("b", "answer"), ("a", more, 10))
    got, said = found.collect(), {(r.stratum, r.sample): r for r in report.collect()}
    assert len(got) == 150 and len({r.key for r in got}) == 150 and all(r.short == 0 for r in said.values())
    n = Counter(r[1] for r in rows)
    for k, target in ((1, 60), (2, 90)):
        taken = Counter(r.stratum for r in got if r.sample == k)
        assert sum(taken.values()) == target and all(abs(taken[s] - target * n[s] / 400) < 1 for s in n)
        assert sum(r.origin == "extra" for r in got if r.sample == k) == 10
    flagged = {r[0] for r in rows if r[1] == "b" and r[3]}
    first = [Counter(r.origin == "first" for r in got if r.sample == k)[True] for k in (1, 2)]
    per = min(len(flagged) // 2, said["b", 1].quota, said["b", 2].quota)
    assert first == [per, per] and all((r.key in flagged) == (r.origin == "first") for r in got if r.stratum == "b")
    episodes = Counter(dict((r[0], r[2]) for r in rows)[r.key] for r in got if r.sample == 1 and r.stratum == "c")
    assert max(episodes.values()) - min(Counter(r[2] for r in rows if r[1] == "c").values()) <= 1 + max(episodes.values())
    _, report = allocation.joint_samples(stock, "key", "kind", "episode", (300, 300), "3")
    assert sum(r.short for r in report.collect()) == 200  # 400 rows for 600 places


def test_splits_of_apps(spark):
    rows = [(k, [None, "a", "b ", "c", "x", " "][k % 6], "st"[k % 2]) for k in range(600)]
    df = spark.createDataFrame(rows, "key bigint, app string, stratum string")
    apps = lambda *x: spark.createDataFrame([(a,) for a in x], "app string")
    app = {k: (a or "").strip() for k, a, _ in rows}
    for by in (True, False):
        got = {n: {r.key for r in allocation.in_and_out(df, apps("a", "b"), apps("c"), (150, 40, 30), 5, by).collect() if r.split == n} for n in ("train", "test_id", "test_ood")}
        assert [len(got[n]) for n in ("train", "test_id", "test_ood")] == [150, 40, 30] and not got["train"] & got["test_id"]
        assert {app[k] for k in got["test_id"]} <= {"a", "b"} and {app[k] for k in got["test_ood"]} == {"c"} and "c" not in {app[k] for k in got["train"]}
        assert "" in {app[k] for k in got["train"]} and "x" in {app[k] for k in got["train"]}
    bare = allocation.in_and_out(df, apps("a", "b"), apps("c"), (900, 40, 30), 5, True, nulls=False).where("split = 'train'").collect()
    assert len(bare) == 160 and {app[r.key] for r in bare} == {"a", "b"}


def test_mirror(spark):
    members = spark.createDataFrame([(1, 1, ["x"]), (1, 2, ["x", "y"]), (2, 1, ["x"]), (9, 9, ["x"])], "episode int, step int, images array<string>")
    state = spark.createDataFrame([(1, 1, "s11", 5), (2, 1, None, 6), (1, 2, "s12", 7)], "episode int, step int, body_text string, n int")
    action = spark.createDataFrame([(1, 2, "a12", 8)], "episode int, step int, body_text string, n int")
    side = F.when(F.size("images") == 2, "action").otherwise("state")
    found, counts = allocation.mirrored(members, {"state": state, "action": action}, side, ["episode", "step"])
    assert sorted((r.episode, r.step, r.body.body_text, r.body.n) for r in found.collect()) == [(1, 1, "s11", 5), (1, 2, "a12", 8), (2, 1, None, 6)]
    assert sorted((r.side, r.members, r.matched, r.dropped) for r in counts.collect()) == [("action", 1, 1, 0), ("state", 3, 2, 1)]
    with pytest.raises(ValueError, match="1 keys of state repeat"):
        allocation.mirrored(members, {"state": state.unionByName(state.limit(1))}, F.lit("state"), ["episode", "step"])


def test_samples_by_policy(spark):
    a, b = "<div><p>one</p><p>two</p></div>", "<div><p>one</p><p>three four</p></div>"
    rows = [(1, ["i"], a, b), (2, ["i", "j"], a, "<action>{}</action>"), (3, ["i"], "", b), (4, ["i"], a, "no markup"), (5, [], a, b), (6, ["i"], a, "  <action>x"), (7, ["i"], a, a)]
    df = spark.createDataFrame(rows, "id int, images array<string>, current string, answer string")
    run = lambda policy, d=df: {r.key: r for r in samples.processed(d, "id", "images", "current", "answer", weights.word_offsets("answer"), policy).collect()}
    even = run("uniform")
    assert {k: r.status for k, r in even.items()} == {1: "ok", 2: "action", 3: "diff_fail", 4: "diff_fail", 5: "action", 6: "action", 7: "ok"}
    assert {k for k, r in even.items() if not r.agrees} == {5, 6} and (even[3].error, even[4].error) == ("no current state", "no next state")
    assert set(even[1].token_weights) == {0.25, 1.0} and set(even[7].token_weights) == {0.25} and all(set(even[k].token_weights) == {1.0} for k in (2, 3, 4, 5, 6))
    assert run("skip").keys() == {1, 2, 5, 6, 7}
    assert run("fail", df.where("id NOT IN (3, 4)")).keys() == {1, 2, 5, 6, 7}
    with pytest.raises(Exception, match="sample 3: no current state"):
        run("fail", df.where("id = 3"))
    told = {r.status: r for r in samples.tally(samples.processed(df, "id", "images", "current", "answer", weights.word_offsets("answer"), "uniform")).collect()}
    assert told["action"].samples == 3 and told["action"].disagree == 2 and told["ok"].even_states == 1 and told["diff_fail"].samples == 2


def test_builds_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/set"
    train = spark.createDataFrame([(1, "state", [0.25, 1.0], 2), (2, "action", [1.0], 1)], "key int, kind string, token_weights array<double>, n_tokens int")
    test = spark.createDataFrame([(9,)], "key int")
    rules = lambda n: builds.sample_rules({"train": ("kind", n)}, "test", "key")
    with pytest.raises(FileNotFoundError):
        builds.current(spark, path)
    assert builds.published(spark, path, {"train": train, "test": test}, rules(2)) == 1
    before = sorted(builds.current(spark, path)["train"].collect())
    bad = {
        "keys of the test": (train.withColumn("key", F.lit(9)), 2),
        "1 rows|2 of 3": (train, 3),
        "unknown weights": (train.withColumn("token_weights", F.array(F.lit(0.7), F.lit(1.0))).withColumn("n_tokens", F.lit(2)), 2),
        "tokens without a weight": (train.withColumn("n_tokens", F.lit(3)), 2),
        "even states": (train.withColumn("kind", F.lit("state")).withColumn("token_weights", F.array(F.lit(1.0))).withColumn("n_tokens", F.lit(1)), 2),
    }
    for rule, (df, n) in bad.items():
        with pytest.raises(builds.BuildFailed, match=rule):
            builds.published(spark, path, {"train": df, "test": test}, rules(n))
    broken = train.withColumn("key", F.raise_error(F.lit("broken step")).cast("int"))
    with pytest.raises(Exception, match="broken step"):
        builds.published(spark, path, {"train": train, "test": broken}, rules(2))
    assert builds.versions(spark, path) == [1] and sorted(builds.current(spark, path)["train"].collect()) == before
    assert builds.published(spark, path, {"train": train.limit(1), "test": test}, rules(1)) == 2
    assert builds.current(spark, path)["train"].count() == 1 and builds.current(spark, path, 1)["train"].count() == 2


def three(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, current string, truth string, pred string")
    return [trees.paired(df, "k", a, b) for a, b in (("current", "truth"), ("current", "pred"), ("pred", "truth"))]


def test_audit_of_each_outcome(spark):
    current = "<ul><li>one two</li><li>three four</li><p>five</p><i>six</i></ul>"
    truth = "<ul><li>one two</li><li>three nine</li><b>new word</b><i>six</i></ul>"
    pred = "<ul><li>one two</li><li>three four</li><b>new thing</b><i>six seven</i></ul>"
    audit = {(r.side, r.kind, r.pos): (r.other, r.outcome) for r in audits.audited(*three(spark, [(1, current, truth, pred)])).collect()}
    assert audit["true", "M", 2] == (2, "copied") and audit["true", "A", 3] == (3, "loose") and audit["true", "D", 3] == (None, "strict")
    assert audit["predicted", "A", 3] == (3, "loose") and audit["predicted", "M", 4] == (4, "nochange") and audit["predicted", "D", 3] == (None, "strict")
    marks = {(r.tree, r.pos): r.mark for r in audits.marks(three(spark, [(1, current, truth, pred)])[0]).collect()}
    assert marks["current", 3] == "deleted" and marks["next", 3] == "added" and marks["next", 2] == "modified" and ("next", 1) not in marks


def test_audit_adds_up(spark):
    rng = random.Random(4)

    def page():
        return "<ul>" + "".join(f"<{t}>{' '.join(rng.choices('abcdef', k=rng.randrange(4)))}</{t}>" for t in rng.choices(["li", "p", "i"], k=rng.randrange(6))) + "</ul>"

    rows = [(k, page(), page(), page()) for k in range(60)] + [(60, "", "<p>x</p>", "<p>x</p>"), (61, "<p>x</p>", "<p>x</p>", ""), (62, "<p>x</p>", "", "<p>y</p>"), (63, "<p>x</p>", "<p>x</p>", "<p>x</p>"), (64, None, None, None)]
    found = [allocation.held(x, "pairs") for x in three(spark, rows)]
    by_audit, by_row = audits.summed(audits.audited(*found), found[0]), trees.state_diff(*found)
    assert by_audit.count() == 65 and audits.differences(by_audit, by_row).collect() == []
    wrong = by_audit.withColumn("n_change_pred", F.col("n_change_pred") + F.when(F.col("key") == 7, 1).otherwise(0)).where("key <> 9")
    assert sorted((r.key, r.measure) for r in audits.differences(wrong, by_row).collect()) == [(7, "n_change_pred"), (9, "key")]


def plain_audit(current, truth, pred):
    """(side, kind, pos, other, outcome) by sets of one row."""
    n, ct, cp, pt = [len(markup.elements(x)) for x in (current, truth, pred)], *(matching.pairs(*map(markup.elements, x)) for x in ((current, truth), (current, pred), (pred, truth)))

    def changes(found, size, claims):
        same, mod = {x[1] for x in found if x[3] >= 1}, {x[1] for x in found if x[3] < 1}
        return {k: "M" if k in mod else "A" for k in range(size) if k not in same}, set(range(n[0])) - {x[0] for x in found} if claims else set()

    (true, lost), (claimed, dropped) = changes(ct, n[1], True), changes(cp, n[2], n[2] > 0)
    out = [(name, "D", k, None, "strict" if k in theirs else none) for name, mine, theirs, none in (("true", lost, dropped, "missed"), ("predicted", dropped, lost, "made_up")) for k in mine]
    for name, mine, theirs, at, same, none in (("true", true, claimed, 1, "copied", "missed"), ("predicted", claimed, true, 0, "nochange", "made_up")):
        by = {x[at]: (x[1 - at], x[3]) for x in pt}
        out += [(name, kind, k, by.get(k, (None,))[0], none if k not in by else same if by[k][0] not in theirs else "strict" if by[k][1] >= 0.9 else "loose") for k, kind in mine.items()]
    return out


def test_audit_of_rows_needs_no_join(spark):
    rng = random.Random(9)
    page = lambda: "<ul>" + "".join(f"<{t}>{' '.join(rng.choices('abcd', k=rng.randrange(3)))}</{t}>" for t in rng.choices(["li", "p", "i"], k=rng.randrange(6))) + "</ul>"
    rows = [(k, page(), page(), page()) for k in range(50)] + [(50, "", "<p>x</p>", ""), (51, "<p>x</p>", "", "<p>y</p>"), (52, None, None, None), (53, "<p>x</p>", "<p>x</p>", "")]
    df = spark.createDataFrame(rows, "k bigint, current string, truth string, pred string")
    got = audits.of_states(trees.states(df, "k", "current", "truth", "pred"))
    want = [(k, *x) for k, *texts in rows for x in plain_audit(*texts)]
    known = lambda found: sorted(found, key=str)
    assert known((r.key, r.side, r.kind, r.pos, r.other, r.outcome) for r in got.collect()) == known(want)
    assert known(audits.audited(*three(spark, rows)).collect()) == known(got.collect())
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_absorbed_texts(spark):
    odd = "<a><b><c id='x'>1</c><c>2<d/></c></b>tail<e><f/></e></a>"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    rows += [(-1, odd), (-2, None), (-3, ""), (-4, "<p>" * 300 + "deep" + "</p>" * 300), (-5, "<div>" + "".join(f"<p><i>{k}</i></p>" for k in range(97)) + "</div>"), (-6, "<div>\n<p aria-label='q'></p></div>")]
    got = {(r.key, r.pos): (r.tag, r.text) for r in absorbed.full_texts(spark.createDataFrame(rows, "k bigint, t string").repartition(4), "k", "t").collect()}
    want = {}
    for key, text in rows:
        doc = markup.parsed(text)
        want |= {(key, k): (n.tag.lower(), markup.full_text(doc, k)) for k, n in enumerate(doc.nodes)}
    assert got == want


def smoothed(h, r):
    """The definition with counts of each length."""
    if not h or not r or not set(h) & set(r):
        return 0.0
    logs, missed, order = 0.0, 0, 0
    for n in range(1, min(4, len(h)) + 1):
        mine, theirs = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (h, r))
        hit, order = sum((mine & theirs).values()), n
        missed += hit == 0
        logs += math.log((hit or 2.0**-missed) / (len(h) - n + 1))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(logs / order)


def test_word_runs(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices("abcd", k=rng.randrange(0, 14)))
    rows = [(k, text(), text()) for k in range(150)] + [(200, None, "a"), (201, "a b c d e", "a b c d e"), (202, "", "")]
    df = spark.createDataFrame(rows, "k int, h string, r string").repartition(3)
    found = ngrams.matched(df, ["k"], ngrams.blank_tokens(F.col("h")), ngrams.blank_tokens(F.col("r")))
    got = found.select("k", ngrams.bleu4(), ngrams.rouge(1), ngrams.rouge(2), ngrams.sentence_bleu()).collect()
    assert len(got) == len(rows)
    for k, *scores in got:
        h, r = next((x[1] or "", x[2] or "") for x in rows if x[0] == k)
        assert scores == pytest.approx([kernels.bleu4(h, r), kernels.rouge_n(h, r, 1), kernels.rouge_n(h, r, 2), smoothed(h.split(), r.split())])


def test_standard_tokens(spark):
    texts = {"Hello, world!": "Hello , world !", "1,000.5 is 3-4 a-b": "1,000.5 is 3 - 4 a-b", "&quot;x&amp;y&quot; (z)": '" x & y " ( z )', "line-\nbreak\nend.": "linebreak end .", "a.b 5.": "a . b 5 .", None: ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(ngrams.tokens_13a(F.col("t")), " ").alias("x"))
    assert {r.t: r.x for r in df.collect()} == texts


def field(number, kind, body):
    size = []
    n = len(body) if kind == 2 else 0
    while kind == 2:
        size.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            break
    return bytes([number << 3 | kind, *size]) + body


def test_files_are_read_in_stretches(spark, tmp_path):
    rng = random.Random(6)
    payloads = [field(1, 2, field(1, 2, field(1, 2, b"img") + field(2, 2, field(1, 2, field(1, 2, bytes(rng.randrange(0, 300))))))) for _ in range(200)]
    data = b"".join(struct.pack("<Q", len(p)) + b"crc!" + p + b"crc!" for p in payloads)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "plain").write_bytes(data + struct.pack("<Q", 999) + b"crc!short")
    (tmp_path / "in" / "zipped.gz").write_bytes(gzip.compress(data))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "in" / "empty").write_bytes(b"")
    df = tfrecord.split_tfrecords(spark, str(tmp_path / "in"), 1000)
    assert df.rdd.getNumPartitions() > 20
    got = sorted((r.path.rsplit("/", 1)[1], r.seq, bytes(r.raw[0])) for r in df.collect())
    want = [bytes(tfrecord.example(p)["img"][1][0]) for p in payloads]
    assert got == sorted((n, k, w) for n in ("plain", "zipped.gz") for k, w in enumerate(want))
    cut = [s for s in tfrecord.stretches(str(tmp_path / "in"), 1000) if s.path.endswith("plain")]
    assert [k for s in cut for k, _ in tfrecord.records(s)] == list(range(200))


def test_large_files_stay_small_in_memory(tmp_path):
    """A file of 3 GB (with holes) is passed over by lengths alone."""
    import tracemalloc

    path, size = tmp_path / "large", 1 << 20
    with open(path, "wb") as f:
        for k in range(3000):
            f.seek(k * (size + 16))
            f.write(struct.pack("<Q", size))
        f.truncate(3000 * (size + 16))
    parts = tfrecord.stretches(str(path), 128 << 20)
    tracemalloc.start()
    assert sum(1 for _ in tfrecord.records(parts[-1])) + sum(1 for _ in tfrecord.records(parts[0])) > 100
    assert tracemalloc.get_traced_memory()[1] < 8 * size
    tracemalloc.stop()


def test_change_audit_sends_no_table_through_the_driver(spark):
    shown = catalog.QUERIES["diff06_change_audit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown and shown.split("== Initial Plan ==")[0].count("SortMergeJoin") == 2  # the pages of a state, by their numbers
