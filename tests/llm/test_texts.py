import random

import pytest
from pyspark.sql import functions as F

from emberline.llm import bpe, encoding_repair, language_models, personal_data

RUSSIAN = (
    "По словам очевидцев, мост не отвечает на вопросы, пожалуйста, оставайтесь дома. Мост закрыт в полдень, повсюду дым и стекло. "
    "Рынок призывает к спокойствию после дождя, и никто не говорит нам, почему. Вокзал наконец в безопасности сегодня утром. "
    "Школа просит о помощи прямо сейчас, мы всё ещё ждём ответа. Полиция осталась без света, телефоны не работают."
)


def _sample_text():
    import pandas as pd

    return " ".join(sorted(pd.read_parquet("/root/testdata/sf0.001/lang_sample.parquet").text))


REPAIR = encoding_repair.Repair(_sample_text())
GOOD = [
    "L'école brûle encore, c'est déjà la même chose que l'été dernier",
    "Der Bürgermeister wird für Wochen nicht öffnen, überall liegen Glasscherben",
    "¿Alguien sabe por qué el túnel está bajo el agua, mañana habrá más información",
    "NÃO ESQUEÇA A MANHÃ… CORAÇÃO",
    "“O PREFEITO JÁ ESTÁ EM SEGURANÇA ESTA MANHÃ”",
    "à é ô",
    "Рынок закрыт, мы всё ещё ждём ответа",
    "ВОКЗАЛ ОСТАЛСЯ БЕЗ СВЕТА",
    "fire 🔥 ❤️ 👩‍🚒 👍🏽 – “ok” … €5",
    "plain ascii",
    "Ω≈ç√∫ µm, a≈b, c√d ±5 µm, x² + y² ≤ z²",
    "km² and 10€, Sr.ª María, ½ cup, 10°C – 20°C, iPhone™",
    "wait…what, naïve café — “étude” d’été, Wort„Zitat“Ende",
    "Ελλάδα σήμερα, 東京は晴れ, Łódź Žižkov, İstanbul’da",
    "Београд је леп град, Київ зараз",
    "В третий раз мэр призывает к спокойствию прямо сейчас. онлайн",
]


@pytest.mark.parametrize("text", GOOD)
def test_good_text_stays(text):
    assert REPAIR(text) is None


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "koi8-r"])
@pytest.mark.parametrize("text", [GOOD[0], GOOD[1], "Рынок закрыт, мы всё ещё ждём ответа", "“ok” – €5 über"])
def test_round_trip(text, encoding):
    table = {v: c for c, v in encoding_repair._bytes_of(encoding).items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert REPAIR(bad) == (text, 1, True)


def test_nested_layers():
    bad = GOOD[0]
    for _ in range(2):
        bad = bad.encode().decode("latin-1")
    assert REPAIR(bad) == (GOOD[0], 2, True)


@pytest.mark.parametrize(("read", "meant"), [("cp1252", "cp1251"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251")])
def test_single_byte(read, meant):
    text = "Школа просит о помощи прямо сейчас"
    assert REPAIR(text.encode(meant).decode(read))[0] == text


def test_part_of_a_text():
    assert REPAIR("Der Markt wird geräumt, die BrÃ¼cke nicht")[0] == "Der Markt wird geräumt, die Brücke nicht"


def test_lost_characters_are_told():
    assert REPAIR("die Stra�enbahn")[2] is False
    assert REPAIR("thanks ðŸ™")[2] is False


def test_garbled_rows(spark):
    df = spark.createDataFrame([(1, "cafÃ©"), (2, None), (3, ""), (None, "cafÃ©"), (4, "café"), (1, "cafÃ©")], "id bigint, text string").withColumn("restored", F.lit(0))
    rows = encoding_repair.garbled(df, ["id"], "text", RUSSIAN).collect()
    assert sorted((r.id or 0, r.restored) for r in rows) == [(0, "café"), (1, "café"), (1, "café")]
    assert encoding_repair.garbled(df.limit(0), ["id"], "text", RUSSIAN).count() == 0


def _samples():
    import pandas as pd

    found = {}
    for row in pd.read_parquet("/root/testdata/sf0.001/lang_sample.parquet").itertuples():
        found.setdefault(row.lang, []).append(row.text)
    return found


def test_held_out_sentences():
    samples = _samples()
    fitted = language_models.LanguageModels({k: v[::2] for k, v in samples.items()})
    good = total = 0
    for lang, texts in samples.items():
        parts = [language_models.passages(t) for t in texts[1::2]]
        merged = [[[w for p in x for w in p]] for x in parts]
        totals = [fitted.score(x[0])[0].sum(axis=0).argmax() for x in merged]
        good += sum(fitted.languages[k] == lang for k in totals)
        total += len(totals)
    assert good / total >= 0.95


def test_passages_and_rejection(spark):
    samples = spark.read.parquet("/root/testdata/sf0.001/lang_sample.parquet")
    models = language_models.fit(samples)
    english, german = _samples()["en"][0], _samples()["de"][0]
    rows = [(1, f"{english} | {german} #tag http://x.y"), (2, "kerdonvas molnubil taszor"), (3, None), (4, ""), (5, "café live"), (6, german.encode().decode("latin-1"))]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("found", F.lit("clash"))
    got = language_models.languages(df, ["id"], "text", models, RUSSIAN).collect()
    assert sorted((r.id, r.found) for r in got) == [(1, "de"), (1, "en"), (6, "de")]
    assert all(0.5 < r.confidence <= 1 for r in got)


@pytest.mark.parametrize(
    ("label", "named"), [("en", "en"), (" EN-us ", "en"), ("deu", "de"), ("pt_BR", "pt"), ("xx", None), ("", None), (None, None), ("und", None), ("english", None), ("n/a", None)]
)
def test_labels(spark, label, named):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(language_models.named_language(F.col("l"))).first()[0] == named


def test_bpe_against_the_library():
    import base64

    import public_tokenizers
    import tiktoken

    path, pattern = bpe.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.default_pattern()
    own, pre = bpe.load(path, pattern)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = ["", " ", "<|endoftext|> [CLS]", "a" * 3000, "ab" * 2000, "é" * 500, "​\n\n  x", "😀👩‍🚒", "ﬁne"]
    texts += ["".join(rng.choices("abc de\n1é😀-'", k=rng.randrange(1, 200))) for _ in range(200)]
    for text in texts:
        assert own.encode(pre.findall(text)) == library.encode_ordinary(text)


def test_encode_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    rows = {r.doc_id: list(r.ids) for r in bpe.encode_texts(df).collect()}
    assert rows[1] == [31373, 995]
    assert rows[2] == rows[3] == []
    assert {r.doc_id: r.tokens for r in bpe.encode_texts(df, counts=True).collect()} == {1: 2, 2: 0, 3: 0, None: 1}
    assert bpe.encode_texts(df.limit(0)).count() == 0


CASES = [
    ("mail: anna.kestvik@example.org.", [("email", "anna.kestvik@example.org")]),
    ("<bruno+a (at) remsovas.invalid> or x [at] y [dot] example", [("email", "bruno+a (at) remsovas.invalid"), ("email", "x [at] y [dot] example")]),
    ("write to a.b at example dot com now", [("email", "a.b at example dot com")]),
    ("meet @ the corner, @kestvik at noon", []),
    ("Call +49 (0)30 23125-613 or 020 7946 0980.", [("phone", "+49 (0)30 23125-613"), ("phone", "020 7946 0980")]),
    ("(702) 555-0189 06.39.98.37.57 +14155550147", [("phone", "(702) 555-0189"), ("phone", "06.39.98.37.57"), ("phone", "+14155550147")]),
    ("555 0179 ext. 76 if", [("phone", "555 0179 ext. 76")]),
    ("ISBN 000-0-57-937094-0, host 192.0.2.235, 2024-03-08, ticket #684-19535, tweet <260029738713971748>", []),
    ("ID no. QQ 56 82 56 B passport DZ1234567", [("idno", "QQ 56 82 56 B"), ("idno", "DZ1234567")]),
    ("national number 900-92-9414 and 0 57 13 63 889 725 74", [("idno", "900-92-9414"), ("idno", "0 57 13 63 889 725 74")]),
    ("Meet outside 136b Pelri Lane, Flat 2 at", [("address", "136b Pelri Lane, Flat 2")]),
    ("bus 49 to Kanlirberg Road depot, route 86 street race, 63 of 100 streets", []),
    ("au 140 bis, bd Firrul et 93 rue Soszil, 99594 Laszilgate", [("address", "140 bis, bd Firrul"), ("address", "93 rue Soszil, 99594 Laszilgate")]),
    ("en Plaza de Tusnur 54, C/ Vamfi, nº 109", [("address", "Plaza de Tusnur 54"), ("address", "C/ Vamfi, nº 109")]),
    ("Treffpunkt: Sernusweg 52a", [("address", "Sernusweg 52a")]),
    ("Dr KARIM LURMOVIC and Kestvik, Anna met T. Corvmont", [("name", "KARIM LURMOVIC"), ("name", "Kestvik, Anna"), ("name", "T. Corvmont")]),
    ("Lucia de la Garssten-Ebbwick, Paul J. Tolvquist", [("name", "Lucia de la Garssten-Ebbwick"), ("name", "Paul J. Tolvquist")]),
    ("Storm Adam, Anna, Kestvik lost, @anna_kestvik", []),
]


#: Parts of names that a table of documents may have shown.
FINDER = personal_data.Finder(parts=personal_data.Parts(frozenset({"karim", "anna", "lucia", "paul", "adam"}), frozenset({"lurmovic", "kestvik", "corvmont", "garssten", "ebbwick", "tolvquist"})))


@pytest.mark.parametrize(("text", "items"), CASES)
def test_items(text, items):
    found = FINDER(text)
    assert [(kind, text[a:b]) for kind, a, b in found] == items


def test_positions_are_code_points_and_the_rest_stays(spark):
    long = "x " * 200_000 + "mail a@example.org"
    rows = [(1, "😀İ mail a@example.org"), (2, None), (3, ""), (4, long), (5, "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pii_type", F.lit(1))
    got = {(r.doc_id, r.pii_type, r.start_pos, r.end_pos) for r in personal_data.find_items(df, ["doc_id"], "text").collect()}
    assert got == {(1, "email", 8, 21), (4, "email", 400_005, 400_018)}
    texts = {r.doc_id: (r.redacted, r["items"]) for r in personal_data.redact(df, ["doc_id"], "text").collect()}
    assert texts[1] == ("😀İ mail [EMAIL]", 1)
    assert texts[2] == (None, 0)
    assert texts[3] == ("", 0)
    assert texts[5] == ("none", 0)
    assert personal_data.find_items(df.limit(0), ["doc_id"], "text").count() == 0


#: Names that no list in the package holds, in several forms: a text, and the names in it.
HELD_OUT = [
    ("Then Dr. Aurelia Okonkwo treated them", ["Aurelia Okonkwo"]),
    ("Frau Łucja von Szymańska-Ortiz kam", ["Łucja von Szymańska-Ortiz"]),
    ("Mrs Okonkwo, Aurelia lost her shop", ["Okonkwo, Aurelia"]),
    ("Foto: JIRO TANAKA\nFogo no rio", ["JIRO TANAKA"]),
    ("According to J. R. Okonkwo, the road was closed", ["J. R. Okonkwo"]),
    ("we asked: A. Tanaka was there", ["A. Tanaka"]),
    ("John Smith said the bridge was closed", ["John Smith"]),
    ("It rained. Mary Johnson told us to wait", ["Mary Johnson"]),
    ("We spoke with Wei Zhang near the market", ["Wei Zhang"]),
    ("contact person Priya Raman, tel. 555-0134 ext 5", ["Priya Raman"]),
    ("Reported by Ivan Petrov for the evening news", ["Ivan Petrov"]),
    ("I met with Chidi N. Eze and left", ["Chidi N. Eze"]),
    ("Her name is Fatima al Zahrani.", ["Fatima al Zahrani"]),
    ("Missing since noon: O'Brien, Siobhan", ["O'Brien, Siobhan"]),
    ("El señor Joaquín de la Peña busca agua", ["Joaquín de la Peña"]),
    ("Selon Maëlle Lefèvre, la route est vide", ["Maëlle Lefèvre"]),
    ("Laut Jürgen Grünewald war es still", ["Jürgen Grünewald"]),
    ("Secondo Chiara Bianchi, la strada è vuota", ["Chiara Bianchi"]),
    ("По словам Марины Соколовой, дорога пуста", ["Марины Соколовой"]),
    ("meneer Sjoerd van der Meulen zoekt hulp", ["Sjoerd van der Meulen"]),
    ("Photo by Hiroshi Sato", ["Hiroshi Sato"]),
    ("Mayor Olu Adeyemi spoke. Nothing else", ["Olu Adeyemi"]),
    ("Witness Kofi Mensah-Boateng: it fell", ["Kofi Mensah-Boateng"]),
    ("Laut den Leuten, plan B. The bridge. Dr who came; Storm Aurelia Okonkwo", []),
    ("Live on 12 Oak Dr and 5 p.m. Then it rained", []),
    ("According to the Red Cross, Fire Department and City Council said no", []),
    ("Green Valley Market is open; Long Island ferry is not", []),
    ("contact @jane_doe or #jane_doe", []),
    ("The Ministry of Health said Monday", []),
    ("Storm Boris hit Port Arthur. Photo by drone", []),
]


def test_names_held_out():
    found = good = wanted = 0
    for text, names in HELD_OUT:
        got = [text[a:b] for kind, a, b in personal_data.Finder()(text) if kind == "name"]
        found, wanted, good = found + len(got), wanted + len(names), good + len(set(got) & set(names))
    assert good >= 0.9 * wanted
    assert good >= 0.9 * found


def test_parts_are_learned_from_all_texts(spark):
    rows = [(f"Dr Aurelia Okonkwo treated {k}",) for k in range(3)] + [("we met AURELIA OKONKWO twice; later okonkwo, aurelia left, A. Okonkwo too",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    parts = personal_data.learn_parts(df, "text")
    assert parts == personal_data.Parts(frozenset({"aurelia"}), frozenset({"okonkwo"}))
    text = rows[3][0]
    assert [text[a:b] for _, a, b in personal_data.Finder(parts=parts)(text)] == ["AURELIA OKONKWO", "okonkwo, aurelia", "A. Okonkwo"]
    assert personal_data.learn_parts(df.limit(0), "text") == personal_data.Parts()


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("x " + "a" * 95 + "@" + "b" * 60 + "." + "c" * 75 + ".example.org y", [("email", "a" * 95 + "@" + "b" * 60 + "." + "c" * 75 + ".example.org")]),
        ("x " + "q" * 5000 + "@example.org", [("email", "q" * 5000 + "@example.org")]),
        ("Meet at 12 " + "L" * 150 + " Street, Bigtown", [("address", "12 " + "L" * 150 + " Street, Bigtown")]),
        ("pay to GB82 WEST 1234 5698 7654 32 today", [("idno", "GB82 WEST 1234 5698 7654 32")]),
        ("pay to DE89370400440532013000.", [("idno", "DE89370400440532013000")]),
        ("ref DE89370400440532013001.", []),
        ("passport no. X12345678 and tel:+4930231256130", [("idno", "X12345678"), ("phone", "+4930231256130")]),
        ("DNI: 12.345.678 then WhatsApp 0171-5551234", [("idno", "12.345.678"), ("phone", "0171-5551234")]),
        ("see https://x.example/12345678A?q=020-7946-0980 now", []),
        ("mailto:ana@example.org", [("email", "ana@example.org")]),
    ],
)
def test_boundaries_and_cues(text, items):
    assert [(kind, text[a:b]) for kind, a, b in personal_data.Finder()(text)] == items


@pytest.mark.parametrize("encoding", ["cp850", "cp866"])
@pytest.mark.parametrize("text", [GOOD[0], GOOD[1], "Рынок закрыт, мы всё ещё ждём ответа", "“ok” – €5 über", "it’s closed, don’t wait", "fire 🔥 in the street"])
def test_round_trip_through_dos_encodings(text, encoding):
    table = {v: c for c, v in encoding_repair._bytes_of(encoding).items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert REPAIR(bad) == (text, 1, True)


OTHERS = ["日本の天気は今日も晴れです", "Ο δρόμος είναι κλειστός σήμερα", "الطريق مغلق اليوم", "הכביש סגור היום", "오늘 길이 막혔다", "सड़क आज बंद है"]


def _misread(text, encoding):
    table = {v: c for c, v in encoding_repair._bytes_of(encoding).items()}
    return "".join(chr(b) if b < 128 else table[b] for b in text.encode())


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "mac_roman"])
@pytest.mark.parametrize("text", OTHERS)
def test_other_scripts(text, encoding):
    assert REPAIR(_misread(text, encoding)) == (text, 1, True)


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252"])
@pytest.mark.parametrize("layers", [5, 6, 9])
def test_any_number_of_layers(layers, encoding):
    bad = GOOD[0]
    for _ in range(layers):
        bad = _misread(bad, encoding)
    assert REPAIR(bad) == (GOOD[0], layers, True)


def test_single_byte_below_other_layers():
    text = "Школа просит о помощи прямо сейчас"
    for meant in ("cp1251", "koi8-r"):
        assert REPAIR(_misread(text.encode(meant).decode("latin-1"), "latin-1")) == (text, 2, True)


@pytest.mark.parametrize(("read", "meant"), [("cp1252", "cp850"), ("cp1252", "cp437"), ("latin-1", "mac_roman"), ("cp850", "mac_roman"), ("mac_roman", "cp850")])
def test_western_single_byte(read, meant):
    assert REPAIR(GOOD[0].encode(meant).decode(read))[0] == GOOD[0]


MIXED = [
    ("The bridge is closed since yesterday and nobody tells us why los pescadores esperan a los equipos de rescate esta tarde", {"en", "es"}),
    ("According to witnesses the market was evacuated mais la route est toujours fermée depuis hier soir", {"en", "fr"}),
    ("Der Markt ist geschlossen aber the police asked everyone to leave the main square now", {"de", "en"}),
    ("At noon the tunnel remains quiet � Les pompiers demandent des réponses pendant la nuit", {"en", "fr"}),
    ("He said c'est la vie and left the market with a smile", {"en"}),
]


def test_languages_without_punctuation_between_and_any_partitioning(spark):
    samples = spark.read.parquet("/root/testdata/sf0.001/lang_sample.parquet")
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = spark.createDataFrame(list(enumerate(x for x, _ in MIXED)), "id bigint, text string")
    results = []
    for parts in (1, 7):
        models = language_models.fit(samples.repartition(parts), more.repartition(parts), most_each=5)
        rows = language_models.languages(df, ["id"], "text", models, RUSSIAN).collect()
        results.append(sorted(map(tuple, rows)))
        assert [{r.found for r in rows if r.id == k} for k in range(len(MIXED))] == [langs for _, langs in MIXED]
    assert results[0] == results[1]


def test_bounds_are_calibrated():
    bounds = language_models.calibrated(_samples())
    assert 1.5 < bounds.likely < bounds.noise < 4.5
    assert bounds.least >= 2 and bounds.gain > 10
    assert language_models.calibrated({"en": ["one two three"]}) == language_models.Bounds()


def test_models_are_of_all_samples_and_all_labelled_texts(spark):
    texts = _samples()
    sentence = next(t for t in texts["ru"] if len(language_models.passages(t)) == 1)
    rows = [("de", texts["de"][k % len(texts["de"])]) for k in range(2100)] + [("ru", t) for t in texts["ru"]]
    named = [" ".join([*language_models.passages(sentence)[0], "щъ" + "".join(chr(ord("а") + int(d)) for d in str(k))]) for k in range(300)]
    more = [("ru", t) for t in named] + [("de", t) for t in named] + [("xx", sentence), (None, sentence), ("ru", None), ("ru", "")]
    samples = {"de": [t for lang, t in rows if lang == "de"], "ru": texts["ru"]}
    whole = language_models.LanguageModels(samples | {"ru": [*texts["ru"], *named]})
    for parts in (1, 7):
        fitted = language_models.fit(spark.createDataFrame(rows, "lang string, text string").repartition(parts), spark.createDataFrame(more, "lang string, text string").repartition(parts))
        assert fitted.languages == ["de", "ru"]
        assert fitted.alphabet == whole.alphabet
        assert all((a == b).all() for a, b in zip([*fitted.grams, *fitted.values, *fitted.weights], [*whole.grams, *whole.values, *whole.weights], strict=True))


def test_of_a_mixed_labelled_passage_only_the_labels_part_is_fitted(spark):
    samples = spark.read.parquet("/root/testdata/sf0.001/lang_sample.parquet")
    first = language_models.fit(samples)
    fitted = language_models.fit(samples, spark.createDataFrame([("en", MIXED[0][0])] * 9, "lang string, text string"))
    gain = (fitted.score(["yesterday", "pescadores"])[0] - first.score(["yesterday", "pescadores"])[0])[:, first.languages.index("en")]
    assert gain[0] > 2
    assert gain[1] < 1


def test_names_in_the_texts_of_several_languages_are_not_learned(spark):
    samples = spark.read.parquet("/root/testdata/sf0.001/lang_sample.parquet")
    texts, first = _samples(), language_models.fit(samples)
    named = []
    for lang, word in (("nl", "fietsenmaker"), ("fr", "boulangerie")):
        sentence = next(t for t in texts[lang] if len(language_models.passages(t)) == 1)
        named.append((lang, " ".join([*language_models.passages(sentence)[0], "kurzomfelzir", word])))
    fitted = language_models.fit(samples, spark.createDataFrame(named * 40, "lang string, text string"))
    words = ["kurzomfelzir", "fietsenmaker", "boulangerie"]
    gain = fitted.score(words)[0] - first.score(words)[0]
    assert gain[0].max() < 2
    assert gain[1, first.languages.index("nl")] > 4
    assert gain[2, first.languages.index("fr")] > 4


def test_letters_of_other_scripts_leave_the_models_alone():
    samples = _samples()
    odd = "".join(chr(0x4E00 + k) for k in range(5000))
    fitted, plain = (language_models.LanguageModels(samples | {"en": [*samples["en"], *more]}) for more in ([" ".join(odd)], []))
    assert fitted.alphabet == plain.alphabet
    assert (fitted.score(["bridge", odd[:3]])[0] == plain.score(["bridge", odd[:3]])[0]).all()


def test_letters_are_of_all_samples(spark):
    texts = [f"{GOOD[0]} {k}" for k in range(2100)] + [RUSSIAN, None, "", "東京 x"]
    whole = encoding_repair.Repair(" ".join(t for t in texts if t))
    bad = "Школа просит о помощи прямо сейчас".encode("koi8-r").decode("latin-1")
    for parts in (1, 7):
        letters = encoding_repair.letters_of(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        repair = encoding_repair.Repair(letters)
        assert (repair.cyrillic, repair.latin) == (whole.cyrillic, whole.latin)
        assert repair(bad) == whole(bad) == ("Школа просит о помощи прямо сейчас", 1, True)
