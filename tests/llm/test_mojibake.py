import random
from collections import Counter

import pandas as pd

from tessaro.llm.mojibake import CHAINS, FAMILIES, _codes, _places, _quantile, as_bytes, clean_passages, garblings, half, readings, restore, train

PLAIN = {
    "fr": "La volatilité réalisée passe de 21 à 34 % ; l’écart reste élevé après la clôture.", "de": "Größere Fenster ändern das Vorzeichen, die Prüfung bleibt maßgeblich für später.",
    "ru": "Последняя свеча ещё не закрыта, показывать её рано и незачем.", "zh": "最后一根线尚未结束，不应展示。手续费吃掉全部收益。", "pl": "Zmienność wzrosła, obrót słabszy niż zwykle; przewagę zjada prowizja.",
    "ja": "最後の足はまだ確定していない。手数料で優位性は消える。", "en": "The café dashboard still shows last month’s regime – “noise”, he wrote.", "sym": "Weights were clipped to ×3, cost ±2 bps, ≈ 5 µs; SÃO and ÂNGULO are names.",
}
WRONG = [("cp1252", "utf_8"), ("latin_1", "utf_8"), ("cp437", "utf_8"), ("mac_roman", "utf_8"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"), ("cp1252", "gbk"), ("gbk", "utf_8")]


def corpus():
    rng = random.Random(1)
    clean = [(f"{rng.choice(list(PLAIN.values()))} {i}. {rng.choice(list(PLAIN.values()))}", None) for i in range(600)]
    bad = []
    for lang, text in PLAIN.items():
        for w, t in WRONG:
            try:
                raw = text.encode(t)
                garbled = raw.decode(w) if w not in ("cp1252",) else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
            except UnicodeError:
                continue
            if garbled != text and (t == "utf_8" or (lang, t) in {("ru", "cp1251"), ("zh", "gbk")}):
                bad.append((f"{PLAIN['en']} {garbled}", f"{PLAIN['en']} {text}"))
    return clean, bad


def test_found_and_restored(spark):
    clean, bad = corpus()
    double = PLAIN["fr"].encode().decode("latin_1").encode().decode("latin_1")
    odd = [(None, False), ("", False), ("   ", False), ("plain ascii", False), ("Quoted: `Ã©` and `�` are fine – really.", False), ("Lost: instant�neas here.", True), (double, True), ("é" * 50_000, False)]
    rows = [(i, t) for i, (t, _) in enumerate(clean + bad)] + [(10_000 + i, t) for i, (t, _) in enumerate(odd)] + [(1, clean[1][0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS garbled", "1 AS key")
    got = {r.doc_id: r for r in restore(spark, df).collect()}
    assert not [i for i in range(len(clean)) if got[i].garbled]
    found = [got[len(clean) + i] for i in range(len(bad))]
    assert all(r.garbled for r in found)
    assert sum(r.text == t for r, (_, t) in zip(found, bad)) >= 0.9 * len(bad)
    assert [got[10_000 + i].garbled for i in range(len(odd))] == [g for _, g in odd]
    assert got[10_000 + 6].text == PLAIN["fr"] and not got[10_000 + 5].whole and got[10_000].text is None


def test_nothing(spark):
    assert restore(spark, spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_bytes_and_readings():
    assert as_bytes("Ã©", "cp1252") == b"\xc3\xa9" and as_bytes("\x81", "cp1252") == b"\x81" and as_bytes("日", "cp1252") is None
    assert readings("Ã©")["é"] == (("cp1252", "utf_8"),) and not any("\x00" in r for r in readings("é"))


def test_legacy_chains_are_found_however_often_the_corpus_repeats(spark):
    names = {"ru": ("cp1252", "cp1251"), "zh": ("cp1252", "gbk")}
    for copies in (1, 40):
        rows = []
        for lang, (w, t) in names.items():
            for i in range(300 * copies):
                text = f"{PLAIN['en']} {i % 300}. {PLAIN[lang]}"
                rows.append((len(rows), text, False))
                if i % 300 < 30:
                    raw = PLAIN[lang].encode(t)
                    rows.append((len(rows), f"{PLAIN['en']} {i % 300}. " + "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw), True))
        got = {r.doc_id: r.garbled for r in restore(spark, spark.createDataFrame(rows, "doc_id bigint, text string, truth boolean")).collect()}
        assert not [t for i, t, truth in rows if got[i] != truth]


def test_every_distinct_passage_sets_the_margin(spark):
    texts = [f"Der Wert {i} fällt für sich später aus." for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts * 2 + ["plain ascii", "Quoted: `Ã©`.", None, ""])]
    got = Counter()
    for r in clean_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r.passage] += r.n
    assert got == {f"Der Wert {'0' * k} fällt für sich später aus.": n for k, n in ((1, 10), (2, 90), (3, 500))}
    gains = pd.DataFrame({"gain": [5.0, 0.0, 1.0], "n": [1, 98, 1]})
    assert [_quantile(gains, q) for q in (0.01, 0.98, 0.99, 1.0)] == [0.0, 0.0, 1.0, 5.0]


def test_halves_are_held_out_and_garbled_by_every_family(spark):
    texts = [f"{PLAIN['de']} Größe {chr(0x4E00 + i)} zählt." for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key bigint, text string")
    where = {r.text: r.half for r in df.select("text", half(df.text).alias("half")).collect()}
    models = train(spark, df)
    for i, text in enumerate(texts):
        own = _places(_codes(f"Größe {chr(0x4E00 + i)} zählt."))[2][6 - 2]
        assert [m.uni[own] for m in models] == [1 - where[text], where[text], 1]
    done = {f for t in PLAIN.values() for part in (t, *t.split()) for f in garblings(part)}
    assert done == {*FAMILIES, ("twice", "utf_8")} and sum(map(len, FAMILIES.values())) == len(CHAINS)
    assert garblings("é")[("western", "utf_8")] == "Ã©"
