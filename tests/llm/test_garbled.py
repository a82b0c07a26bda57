import random

from parlaweave.llm import garbled as G

CLEAN = "a comissão não aprovou a redação do orçamento próximo e a população pediu à Mesa a situação é grave já há números É preciso AUDIÊNCIA PÚBLICA".split()


def test_round_trip():
    for k, (_, steps) in enumerate(G.CHANNELS):
        for word in ("comissão", "próximo", "É", "orçamento"):
            seen = word
            for read_as, really in reversed(steps):
                seen = "".join(bytes([b]).decode(read_as, "replace") if read_as != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in seen.encode(really))
            if steps and seen != word and G.LOST not in seen:
                assert (k, word) in G.decodings(seen), (G.CHANNELS[k], word, seen)
    assert G.fill("reda��o.", "redação") == "redação." and G.fill("REDA��O", "redação") == "REDAÇÃO"


def test_documents(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(CLEAN) for _ in range(n))
    docs = {k: text(60) for k in range(200)}
    want = {}
    for k, (wrong, right) in {300: ("cp1252", "utf-8"), 301: ("mac_roman", "utf-8"), 302: ("cp850", "cp1252"), 303: ("cp437", "cp1252"), 304: ("cp1252", "cp850"), 305: ("cp1251", "utf-8")}.items():
        want[k] = text(60)
        docs[k] = "".join(bytes([b]).decode(wrong, "replace").replace("�", chr(b)) for b in want[k].encode(right))
    want[306] = "a comissão não aprovou a redação"
    docs[306] = "a comiss�o n�o aprovou a reda��o"
    want[307] = docs[0] + " comissão " + docs[1]
    docs[307] = docs[0] + " comissÃ£o " + docs[1]
    docs |= {308: None, 309: "", 310: "38°C em “Straße” e fjørd, 3½% (± 0,4) ® © § 2º € 5 µg ¿Quién? ¡Nadie!", 311: docs[300]}
    want[311] = want[300]
    df = spark.createDataFrame([*docs.items(), (306, docs[306])], "doc_id long, text string").withColumnRenamed("x", "pos")
    got = {r.doc_id: r.restored for r in G.restore(df, "doc_id", "text").collect()}
    assert got.keys() == want.keys()
    right = sum(a == b for k in want for a, b in zip(want[k].split(), got[k].split()))
    assert right / sum(len(w.split()) for w in want.values()) > 0.99
    assert G.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_other_alphabets(spark):
    for word in ("Привет", "καλημέρα", "日本語", "Łódź"):
        for k, codec in ((1, "cp1252"), (3, "mac_roman"), (4, "cp1251"), (5, "cp850")):
            seen = "".join(bytes([b]).decode(codec, "replace").replace(G.LOST, chr(b)) for b in word.encode())
            assert codec == "cp1251" and any(0x80 <= ord(c) < 0xA0 for c in seen) or (k, word) in G.decodings(seen), (word, codec, seen)
    for right in ("Привет,", "São", "disse—é", "—é", "“áé”", "ÀS", "Łódź"):
        assert not [d for d in G.decodings(right) if d[0] and G.CHANNELS[d[0]][1][-1:] and G.CHANNELS[d[0]][1][-1][1] == "utf-8"]
    words = "мы говорим по русски и пишем тоже".split()
    docs = [(i, " ".join(words[i % 3 :])) for i in range(40)] + [(90, "и вот: " + "пишем".encode().decode("cp1252") + " тоже " + "русски".encode().decode("cp1251", "replace"))]
    got = {r.k: r.restored for r in G.restore(spark.createDataFrame(docs, "k long, body string"), "k", "body").collect()}
    assert list(got) == [90] and got[90].startswith("и вот: пишем тоже")


def test_a_key_with_several_texts(spark):
    bad = ["a comissÃ£o aprovou", "a redaÃ§Ã£o e a comissÃ£o", "nÃ£o houve comissÃ£o"]
    docs = [(i, " ".join(CLEAN)) for i in range(40)] + [(99, t) for t in bad] + [(99, bad[0]), (None, bad[0]), (None, bad[1]), (None, bad[1])]
    df = spark.createDataFrame(docs, "k long, body string")
    got = sorted((str(r.k), r.restored, r.n_spans) for r in G.restore(df, "k", "body").collect())
    want = [("a comissão aprovou", 1), ("a redação e a comissão", 2), ("não houve comissão", 2)]
    assert got == sorted([("99", *w) for w in want] + [("None", *w) for w in want[:2]])
    assert "BatchEvalPython" not in G.find_garbled(df, "k", "body")._jdf.queryExecution().toString()
    assert G.find_garbled(df, "k", "body", broadcast_tokens=0).count() == 5
