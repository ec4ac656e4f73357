import io
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusguard.functions.fingerprints import normalized, shingles, simhash64
from corpusguard.mail import metrics, rules, split
from corpusguard.mail.parse import MESSAGE, message, parsed, visible
from corpusguard.sources import mail as source

MATRICES = [  # phishing and ham by suspicious, review, no_signals, error, and published rates in percent
    ((6383, 84, 92, 0), (15221, 11024, 18643, 0), (97.32, 33.91, 29.55, 45.33, 48.64)),
    ((6383, 145, 31, 0), (15236, 12998, 16654, 0), (97.32, 33.94, 29.52, 45.30, 44.78)),
    ((6272, 0, 287, 0), (1918, 18, 42952, 0), (95.62, 4.27, 76.58, 85.05, 95.68)),
    ((6280, 200, 79, 0), (1963, 6522, 36403, 0), (95.75, 4.37, 76.19, 84.85, 82.96)),
]


def rows_of(spark, phishing, ham):
    counts = [("phishing", s, n) for s, n in zip(metrics.STATUSES, phishing, strict=True)] + [("ham", s, n) for s, n in zip(metrics.STATUSES, ham, strict=True)]
    frame = spark.createDataFrame(counts, "label string, status string, n int")
    return frame.where("n > 0").select("label", "status", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


@pytest.mark.parametrize(("phishing", "ham", "rates"), MATRICES)
def test_published_matrices(spark, phishing, ham, rates):
    r = metrics.summary(rows_of(spark, phishing, ham), []).first()
    assert tuple(round(100 * x, 2) for x in (r.recall, r.fpr, r.precision, r.f1, r.strict_accuracy)) == rates
    if rates[0] == 95.75:
        assert [round(100 * x, 2) for x in (r.recall_low, r.recall_high, r.fpr_low, r.fpr_high)] == [95.23, 96.21, 4.19, 4.57]


def test_small_matrix(spark):
    r = metrics.summary(rows_of(spark, (1, 1, 0, 1), (1, 0, 1, 0)), []).first()
    assert (r.recall, r.fpr, r.precision, r.specificity, r.review_rate, r.error_rate) == (pytest.approx(1 / 3), 0.5, 0.5, 0.5, 0.2, 0.2)
    none = metrics.summary(rows_of(spark, (0, 0, 0, 0), (0, 0, 1, 0)), []).first()
    assert none.recall is None and none.recall_low is None and none.f1 is None and none.fpr == 0


def test_statuses_and_weights(spark):
    rows = spark.createDataFrame([("ham", None), ("ham", "odd"), ("phishing", "review")], "label string, status string")
    assert sorted(tuple(r) for r in metrics.confusion(rows, []).collect()) == [("ham", 0, 0, 0, 2), ("phishing", 0, 1, 0, 0)]
    assert sorted((r.label, r.weight) for r in metrics.class_weights(rows, "label").collect()) == [("ham", 0.75), ("phishing", 1.5)]


def test_split_policies(spark):
    names = ["nazario-2025", "nazario-2023", "trec05", "trec07", "spamassassin-easy_ham", "spamassassin-easy_ham_2", "spamassassin-hard_ham", "nazario-2015", "phishing-pot"]
    rows = spark.createDataFrame([(n,) for n in names], "s string")

    def of(*policy):
        return [r[0] for r in rows.select(split.split_of(F.col("s"), *policy)).collect()]

    assert of() == ["test", "validation", "test", "train", "validation", "validation", "validation", "train", "test"]
    assert of(True) == ["test", "validation", "test", "test", "train", "train", "validation", "train", "test"]
    assert of(False, True)[4:7] == ["train", "validation", "test"]
    assert [r[0] for r in rows.select(split.year_of(F.col("s"))).collect()] == ["2025", "2023", "2005", "2007", "2003", "2003", "2003", "2015", "unknown"]


def test_fingerprints():
    assert normalized("ＡＢＣ", " Straße\n x") == "abc strasse x"
    assert shingles("") == [] and shingles("a") == ["a"] and shingles("a b c d") == ["a b c", "b c d"]
    many = shingles(" ".join(str(i) for i in range(1000)))
    assert len(many) == 256 and many[0] == "0 1 2" and many[-1] == "997 998 999"
    import hashlib

    digests = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in ("a b c", "b c d", "c d e")]
    majority = sum(1 << b for b in range(64) if sum(d >> b & 1 for d in digests) >= 2)
    assert simhash64("a b c d e") % (1 << 64) == majority
    assert simhash64("") == 0 and -(1 << 63) <= simhash64("a b c") < 1 << 63


def test_clusters_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(60)] + [0, 0]
    for _ in range(120):
        x = rng.choice(hashes)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            x ^= 1 << rng.randrange(64)
        hashes.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in hashes]
    rows = [(str(x), x, rng.choice(["trec05", "trec07", "nazario-2022"]), f"{i:04}", rng.choice(["ham", "ham", "ham", "phishing"])) for i, x in enumerate(signed)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (hashes[i] ^ hashes[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    frame = spark.createDataFrame(rows, "id string, simhash long, source string, source_id string, label string")
    got = {r.source_id: r.cluster for r in split.clusters(frame).collect()}
    for i in range(len(rows)):
        for j in range(i):
            assert (got[rows[i][3]] == got[rows[j][3]]) == (root(i) == root(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    rank = {"trec05": 0, "nazario-2022": 1, "trec07": 2}
    want = {min(g, key=lambda r: (rank[r[2]], r[2], r[3]))[3] for g in groups.values() if len({r[4] for r in g}) == 1}
    kept, policy = split.prepare(frame, small_test=0)
    assert policy == "trec07_in_train" and {r.source_id for r in kept.collect()} == want
    lost = {r.reason: r.n for r in split.exclusions(split.clusters(frame)).collect()}
    assert sum(lost.values()) == len(rows) - len(want)
    assert split.prepare(frame)[1] == "trec07_in_test"


HTML = "<p>Hi</p><script>x</script><div style='display: none'>no</div><a href='http://a.b/'>http://c.d/ <b>go</b></a><span hidden>h</span>"


def raw(html=None, **headers):
    from email.message import EmailMessage

    m = EmailMessage()
    for k, v in ({"From": "Ann <a@b.org>", "Subject": "S  1"} | headers).items():
        m[k] = v
    m.set_content("plain http://x.y/z text")
    if html:
        m.add_alternative(html, subtype="html")
    return m.as_bytes()


def test_messages(spark):
    assert visible(HTML)[1] == [{"text": "http://c.d/ go", "url": "http://a.b/"}]
    one = message(raw(HTML))
    assert one["sender"] == {"name": "Ann", "email": "a@b.org"} and one["subject"] == "S 1" and one["text"] == "Hi http://c.d/ go"
    two = message(raw())
    assert two["links"] == [{"text": "http://x.y/z", "url": "http://x.y/z"}] and not two["truncated"]
    assert message(raw("<p>" + "word " * 4000))["truncated"] and message(None) is None
    rows = spark.createDataFrame([(1, bytearray(raw(HTML))), (2, None), (3, bytearray(b"\n\n"))], "id int, raw binary")
    got = {r.id: (r.failure, r.message.text if r.message else None) for r in parsed(rows).collect()}
    assert got == {1: (None, "Hi http://c.d/ go"), 2: ("empty", None), 3: ("empty", "")}


def test_observations_and_status(spark):
    def m(text="", sender="a@b.org", links=(), truncated=False):
        return {"sender": {"name": "", "email": sender}, "subject": "", "text": text, "links": [{"text": t, "url": u} for t, u in links], "attachments": [], "truncated": truncated}

    cases = [
        (m(), "no_signals", [], "no_signals"),
        (m("Please enter\nyour password"), "no_signals", [], "no_signals"),
        (m("please ENTER your Password"), "no_signals", ["credential_request"], "review"),
        (m("Введіть ваш ПАРОЛЬ"), "no_signals", ["credential_request"], "review"),
        (m(links=[("x", "https://www.B.org/")]), "no_signals", [], "no_signals"),
        (m(links=[("x", "https://evil.com/")]), "no_signals", ["sender_link_domain_mismatch"], "no_signals"),
        (m(links=[(" http://b.org/a", "https://c.b.org/")]), "review", ["link_label_mismatch"], "suspicious"),
        (m(links=[("http://b.org", "ftp://evil.com/"), ("http:// bad", "http://b.org/")]), "no_signals", [], "no_signals"),
        (m(sender="nobody", truncated=True, links=[("x", "http://z/")]), "no_signals", [], "review"),
        (m(truncated=True), "odd", [], "error"),
    ]
    frame = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], f"id int, message {MESSAGE}, choice string")
    got = {r.id: (r.observations, r.status) for r in rules.assess(frame).collect()}
    assert got == {i: (c[2], c[3]) for i, c in enumerate(cases)}
    good, bad = rules.within_limits(frame)
    assert good.count() == len(cases) and bad.count() == 0
    long = frame.withColumn("message", F.col("message").withField("text", F.repeat(F.lit("x"), 12_001)))
    assert rules.within_limits(long)[1].count() == len(cases)


def add(archive, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    archive.addfile(info, io.BytesIO(data))


def test_sources(spark, tmp_path):
    def read(kind, path, **options):
        frame = source.read(spark, kind, str(path), "s", "ham", **options)
        assert {(r.source, r.label) for r in frame.select("source", "label").collect()} <= {("s", "ham")}
        return sorted((r.source_id, bytes(r.raw)) for r in frame.collect())

    (tmp_path / "box").write_bytes(b"From a\n\none\n\nFrom b\n\n" + b"x" * 300_000 + b"\n\nFrom c\n\nthree\n")
    assert [i for i, _ in read("mbox", tmp_path / "box")] == ["0", "2"]
    assert read("mbox", tmp_path / "box")[1][1] == b"\nthree\n"
    many = [f"Subject: {i}\n\nbody {i}\nFrom within\n" if i % 3 else f"x{i}" for i in range(40)]
    (tmp_path / "many").write_bytes(b"before\n" + "\n".join(f"From a {i}\n{m}" for i, m in enumerate(many)).encode())
    import mailbox

    box = mailbox.mbox(tmp_path / "many")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1m", "97"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert read("mbox", tmp_path / "many") == sorted((str(k), box.get_bytes(k)) for k in box.keys())
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "pot" / "d").mkdir(parents=True)
    (tmp_path / "pot" / "d" / "a.eml").write_bytes(b"x")
    (tmp_path / "pot" / "b.eml").write_bytes(b"y" * 300_000)
    (tmp_path / "pot" / "l.eml").symlink_to(tmp_path / "pot" / "d" / "a.eml")
    assert read("eml", tmp_path / "pot") == [("d/a.eml", b"x")]
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as archive:
        add(archive, "trec/data/inmail.1", b"one")
        add(archive, "trec/data/inmail.2", b"two")
        add(archive, "trec/data/inmail.3", b"x" * 300_000)
        add(archive, "trec/full/index", b"ham ../data/inmail.1\nspam ../data/inmail.2\nham ../data/inmail.3\nodd\n")
    assert read("index_tar", tmp_path / "t.tgz") == [("inmail.1", b"one")]
    with tarfile.open(tmp_path / "s.tbz", "w:bz2") as archive:
        add(archive, "easy/0001.0a1b", b"one")
        add(archive, "easy/cmds", b"no")
    assert read("numbered_tar", tmp_path / "s.tbz") == [("0001.0a1b", b"one")]
    import hashlib

    text = b"sender,subject,body,label\na@b,\"x\ny\",hello,0\nc@d,z,spam,1\n"
    (tmp_path / "c.csv").write_bytes(text)
    digest = hashlib.sha256(text).hexdigest()
    got = read("csv", tmp_path / "c.csv", sha256=digest, ham_count=1)
    assert [i for i, _ in got] == ["1"] and message(got[0][1])["subject"] == "x y"
    for options in ({"sha256": "0", "ham_count": 1}, {"sha256": digest, "ham_count": 2}):
        with pytest.raises(Exception, match="CSV"):
            read("csv", tmp_path / "c.csv", **options)
