import random
import re
import unicodedata as ud

import pyarrow as pa

from marketloom.llm import leaked_passages as lp

random.seed(3)
VOCABULARY = [f"{a}{b}" for a in ("nồi", "điện", "sạc", "kệ", "mẫu", "hàng", "đơn") for b in "abcdefghij"]
ITEMS = [" ".join(random.choice(VOCABULARY) for _ in range(40)) for _ in range(6)]


def words(t):
    t = "".join(c for c in ud.normalize("NFD", t.lower()).replace("đ", "d") if not ud.combining(c))
    return re.findall(r"[^\W_]+", t)


def brute(items, docs):
    def runs(t):
        w = words(t or "")
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    own = {i: runs(t) for i, t in items}
    return {(i, d) for d, t in docs for r in [runs(t)] for i in own if i is not None and own[i] & r}


def documents():
    def dirty(part):
        return "".join(random.choice([w.upper(), w, ud.normalize("NFD", w)]) + random.choice([" ", "\r\n> ", ", ", " *", "  "]) for w in part)

    docs = [(0, None), (1, ""), (2, "ngắn"), (3, ITEMS[0]), (4, ITEMS[0]), (5, "x " * 200_000 + ITEMS[1])]
    for k in range(60):
        item = random.choice(ITEMS).split()
        n, at = random.randint(9, 15), random.randint(0, 20)
        docs.append((10 + k, " ".join(random.choice(VOCABULARY) for _ in range(20)) + " " + dirty(item[at : at + n]) + "| rest of it"))
    return docs


def test_found_against_brute_force(spark, monkeypatch):
    docs = documents()
    items = [*enumerate(ITEMS), (90, None), (91, ""), (92, ITEMS[2]), (None, ITEMS[3])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(items, docs)
    got = [tuple(r) for r in lp.found(d, i, ["kệa"]).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert lp.found(d.limit(0), i).count() == 0 and lp.found(d, i.limit(0)).count() == 0
    monkeypatch.setattr(lp, "MOST_WINDOWS", 0)
    assert {tuple(r) for r in lp.found(d, i, ["kệa"]).collect()} == want


def test_reparameterised():
    item = "Truy vấn KX62778 trả về 79 dòng; kho Orbit bán 12 kg gạo và 30 ml nước, mã KX62778 ghi 79 lần cho khách quen ở chợ đêm ven sông lớn"
    changed = item.replace("KX62778", "AB11111").replace("79", "8").replace("Orbit", "Nova")
    mixed = item.replace("KX62778", "AB11111", 1)
    leaks = lp.Leaks([7], [item], ["orbit", "nova"])
    text = lambda t: pa.array([t], pa.large_string())
    assert leaks.runs(text(changed))[0][:3] == (0, 7, "reparameterised")
    assert leaks.runs(text(item)) == [(0, 7, "exact", len(words(item)))]
    assert [r[2] for r in leaks.runs(text(mixed))] == ["exact"]
    short = "Hỏi kho Orbit có 12 tivi và 5 quạt mới thì còn lại bao nhiêu món hàng"
    leaks = lp.Leaks([7], [short], ["orbit", "nova", "dell", "inspiron"])
    for copy in ("Hỏi kho Nova có 9 tivi và 4 quạt mới thì còn lại bao nhiêu món hàng", short.replace("5 quạt", "6 quạt").replace("Orbit", "Dell Inspiron").replace("12", "1.450"), short.replace("12", "7").replace("5", "7")):
        assert [r[2] for r in leaks.runs(text("mở đầu. " + copy + " hết"))] == ["reparameterised"], copy
    twice = "ở kệ trên cùng mã KX11111 gần cửa sổ và mã KX11111 ở hàng sau cùng"
    assert lp.Leaks([1], [twice]).runs(text(twice.replace("KX11111", "AB22222")))[0][2] == "reparameterised"
    assert lp.Leaks([1], [twice]).runs(text(twice.replace("KX11111", "AB22222", 1).replace("KX11111", "CD3333"))) == []
    assert leaks.runs(text("không có gì")) == []


def test_by_item(spark):
    d = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "item_id long, doc_id long")
    assert sorted(map(tuple, lp.by_item(d).collect())) == [(1, 2), (2, 1)]


def reparameterised_copies(seed=5):
    """Items with numbers, codes, units and names, and copies of them with other ones: (items, copies by item, other texts)."""
    r = random.Random(seed)
    names = ["Orbit", "Nova", "Dell Inspiron", "Zenor", "Sương Biếc Sơn"]
    slot = {"N": lambda: r.choice([str(r.randint(1, 99)), f"{r.randint(1, 9)}.{r.randint(100, 999)}"]), "C": lambda: f"{r.choice('ABXY')}{r.choice('KQRT')}{r.randint(1000, 99999)}", "U": lambda: r.choice(["kg", "g", "ml", "lít"]), "B": lambda: r.choice(names)}
    items, copies = [], []
    for _ in range(60):
        shape = [r.choice("NCUB") if r.random() < 0.25 else r.choice(VOCABULARY) for _ in range(r.randint(16, 40))]
        fill = lambda: " ".join(slot[x]() if x in slot else x for x in shape)  # noqa: B023, E731
        items.append(fill())
        copies.append(" ".join(r.choice(VOCABULARY) for _ in range(15)) + " " + fill() + " " + " ".join(r.choice(VOCABULARY) for _ in range(15)))
    other = [" ".join(slot[x]() if x in slot else x for x in (r.choice("NCUB") if r.random() < 0.25 else r.choice(VOCABULARY) for _ in range(60))) for _ in range(200)]
    return items, copies, other, names


def test_recall_of_reparameterised_items(spark, monkeypatch):
    items, copies, other, names = reparameterised_copies()
    d = spark.createDataFrame([(i, t) for i, t in enumerate(copies + other)], "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words_ = lp.lexicon(spark.createDataFrame([(n,) for n in names], "name string"))
    rows = [tuple(r) for r in lp.passages(d, i, words_).collect()]
    hit = {(r[0], r[1]) for r in rows}
    assert len({k for k in range(60) if (k, k) in hit}) >= 54 and all(a == b for a, b in hit)
    monkeypatch.setattr(lp, "MOST_WINDOWS", 0)
    assert sorted(tuple(r) for r in lp.passages(d, i, words_).collect()) == sorted(rows)
