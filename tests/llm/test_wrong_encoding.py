import pytest

from marketloom.llm import wrong_encoding as we

CLEAN = "Mình mua tủ lạnh ở chợ, giao trễ một ngày. Đừng chụp ảnh khi mặt kính còn ướt, khách quen làm vậy. Giá lúc đó rẻ hơn nhiều, tiền nào của ấy; cửa hàng đổi hàng nhanh"
TRAPS = ["Dòng «ĐẸP LẠ, BỀN LÂU, ĐÚNG GIÁ» in ở đáy hộp", "Nhãn ghi “TẶNG KÈM BÃ…” rồi nhòe mất", "Khẩu hiệu «NHANH MÀ NHÃ» dán", "Hinweis: Für Geräte über 5 kg", "Phím « Entrée » và « Échap »", "Bản in thử có chữ Â‒Ô, Ã‒Õ", "MÃ ĐÃ TÃ CHÃO 45°C €38"]


def damage(t, page, times=1, errors="strict"):
    for _ in range(times):
        raw = t.encode("utf-8")
        t = "".join(bytes([b]).decode(page, "replace") if page != "cp1252" else _cp1252(b, errors) for b in raw)
    return t


def _cp1252(b, errors):
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return "�" if errors == "lost" else chr(b)


def test_table(spark):
    docs = {i: t for i, t in enumerate([CLEAN] * 20 + TRAPS * 3)}
    start = len(docs)
    bad = [damage(CLEAN, "cp1252"), damage(CLEAN, "latin-1"), damage(CLEAN, "cp1251"), damage(CLEAN, "mac_roman"), damage(CLEAN, "cp437"), damage(CLEAN, "cp1252", 2), CLEAN + " " + damage("khách quen làm vậy", "cp1252"), damage(CLEAN, "cp1252", 1, "lost")]
    docs |= {start + k: t for k, t in enumerate(bad)}
    docs |= {900: None, 901: "", 902: "ngắn", 903: bad[0], 904: "ngày thÃ¡ng " * 40_000}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, n int, token string")
    found = sorted(r[0] for r in we.found(df).collect())
    assert found == [*range(start, start + len(bad)), 903, 904]
    out = {r["doc_id"]: r for r in we.restored(df).collect()}
    assert set(out) == set(found)
    for i in [*range(start, start + 6), start + 7]:
        assert out[i]["restored"] == CLEAN, i
    assert out[start + 6]["restored"] == CLEAN + " khách quen làm vậy" and out[start + 7]["complete"]
    assert we.found(df.limit(0)).count() == 0 and we.restored(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1258"])
def test_round_trip(page):
    """Every Vietnamese letter survives every channel."""
    for word in ("Đường", "nghiệp", "ướt", "rẻ", "ẩm", "ỹ", "ắc", "‘x’", "5₫"):
        bad = damage(word, page)
        assert any(we.spells(arcs, len(bad), word) for arcs in we.lattices(bad, page))


def test_windows_letters_lost():
    assert "nga�y" in we.lossy("ngày") and "�a�" in we.lossy("đã")
    assert ("vietnamese", "người", None) in list(we.readings("ngýõÌi"))
    assert we.with_case("ngày", "NGA�Y") == "NGÀY" and we.with_case("đã", "�a�") == "đã"


def test_lattice_holds_every_reading():
    """Lost bytes leave a choice at each place; the lattice holds all of them, whatever their number."""
    word = "ềểộ" * 12
    bad = damage(word, "cp1252", errors="lost")
    arcs = next(we.lattices(bad, "cp1252"))
    assert bad.count("�") >= 12 and we.only_text(arcs, len(bad)) is None and we.spells(arcs, len(bad), word)
    assert not we.spells(arcs, len(bad), word[:-1] + "x")
    cost, text = we.cheapest(arcs, len(bad), {(0, len(bad)): (word, 3.0)}, 99.0)
    assert (cost, text) == (3.0, word)


def brute(arcs, end, known, rare):
    """All ways through a small lattice, their cheapest cost."""
    def ways(i):
        if i == end:
            return [[]]
        return [[(i, j, ch), *rest] for j, ch in arcs.get(i, ()) for rest in ways(j)]

    best = None
    for way in ways(0):
        cost, k = 0.0, 0
        while k < len(way):
            if not we.is_letter(way[k][2]):
                cost, k = cost + we.sign_cost(way[k][2]), k + 1
                continue
            e = k
            while e < len(way) and we.is_letter(way[e][2]):
                e += 1
            cost, k = cost + known.get((way[k][0], way[e - 1][1]), ("", rare))[1], e
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("word", ["ề”ộ", "đề”", "“ộx", "ềề", "a”b”c"])
def test_viterbi_equals_all_ways(word):
    bad = damage(word, "cp1252", errors="lost")
    for arcs in we.lattices(bad, "cp1252"):
        for known in ({}, {(0, len(bad)): ("w", 2.0)}, dict.fromkeys(list(we.slots(arcs, len(bad)))[:2], ("v", 1.0))):
            assert abs(we.cheapest(arcs, len(bad), known, 9.0)[0] - brute(arcs, len(bad), known, 9.0)) < 1e-9


def test_many_passes_other_scripts_and_emoji(spark):
    """Texts that went through a channel five times, garbled emoji and other scripts; found and restored by one decision."""
    clean = {i: CLEAN for i in range(20)}
    bad = {100: (damage(CLEAN, "latin-1", 4), CLEAN), 101: (damage(CLEAN, "cp1252", 5), CLEAN), 102: ("Hàng đẹp " + damage("😀", "cp1252") + " lắm", "Hàng đẹp 😀 lắm"), 103: ("Привет " + damage("Привет всем", "cp1252"), "Привет Привет всем"), 104: (damage("ไทย", "latin-1") + " ok", "ไทย ok")}
    df = spark.createDataFrame([(i, t) for i, t in clean.items()] + [(i, b) for i, (b, _) in bad.items()], "doc_id long, text string")
    assert sorted(r[0] for r in we.found(df).collect()) == sorted(bad)
    out = {r["doc_id"]: r["restored"] for r in we.restored(df).collect()}
    assert {i: out[i] for i in bad} == {i: c for i, (_, c) in bad.items()}
