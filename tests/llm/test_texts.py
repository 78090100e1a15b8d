import random
import time

import pytest

from furrow.llm import leak_index, readability
from furrow.llm.text import plain, words


def test_words_ignore_spelling():
    same = ["L'été d'Ève: <b>24.7</b> kg &amp; straße", "l été  d ÈVE 24 7 KG strasse", "L'été d'Ève 24​.7 kg & stra­ße", "<p>l été</p><!-- no --> d ève,24_7 kg strasse"]
    assert len({tuple(words(s)) for s in same}) == 1
    assert words("a < b and c > d") == ["a", "b", "and", "c", "d"]
    assert plain("x<br/>y", breaks=True) == "x\ny"


@pytest.mark.parametrize(
    "text,want",
    [
        ("x &a\u200bmp; y", "x y"),  # invisible characters inside entities and tags
        ("x <\u200bp> y</\u00adp>", "x y"),
        ("x &lt;p&gt; y &amp;lt;br/&amp;gt; z", "x y z"),  # escaped markup, once and twice
        ("x &amp;amp; y &amp;amp;amp; z", "x y z"),
        ("&#x26;amp;eacute;t&eacute;", "été"),
        ("st<b>raw</b>ber<wbr>ry<br>red</p><p>ripe", "strawberry red ripe"),  # inline tags join, others part
        ("l\u00b4été, l\u2019été", "l été l été"),
        ("a\u034fb c\ufe0fd e\u2060f g\u00adh", "ab cd ef gh"),
        ("e\u200b\u0301te\u0301", "été"),
        ("\u0301 x", "x"),
        ("a < b, c > d; 1 &lt; 2 &gt; 0", "a b c d 1 2 0"),
        ("<?xml?><!DOCTYPE html><x:y z='1'>w", "w"),
        ("", ""),
    ],
)
def test_words_of_each_spelling(text, want):
    assert " ".join(words(text)) == want


def test_open_markup_takes_no_time():
    began = time.time()
    for bad in ("&" + "amp;" * 100_000, "&#38;" * 100_000, "<b" * 100_000, "<!--" * 100_000, "<a" * 100_000, "&" * 100_000, "x." * 200_000, "." * 200_000, "a" * 400_000):
        plain(bad)
        readability.grades(bad, readability.Languages([], {}, ()))
    assert time.time() - began < 30


def brute(docs, items, run):
    out = set()
    for i, t in items:
        w = words(t or "")
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, text in docs:
            v = words(text or "")
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((i, d))
    return out


@pytest.mark.parametrize("seed,shard", [(1, 10**9), (2, 10**9), (3, 40)])
def test_leaks_match_brute_force(spark, seed, shard):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    item = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, item(rng.choice([3, 12, 13, 30, 60]))) for i in range(40)]
    items += [(100, items[5][1]), (101, ["w1"] * 40)]
    docs = [(d, item(rng.randint(0, 200))) for d in range(30)] + [(30, ["w1"] * 100)]
    for d in range(31, 90):
        src = rng.choice(items)[1]
        n = min(len(src), rng.choice([11, 12, 13, 25]))
        at = rng.randint(0, len(src) - n)
        head = item(rng.randint(0, 120)) if d % 2 else [f"z{i}" for i in range(rng.randint(0, 90))]
        docs.append((d, head + src[at : at + n] + item(rng.randint(0, 70))))
    texts = [(d, " ".join(w)) for d, w in docs] + [(200, None), (201, ""), (202, "<p> </p>")]
    evals = [(i, " ".join(w)) for i, w in items] + [(300, None), (301, "")]
    df = spark.createDataFrame([(d, t, 1, 1) for d, t in texts * 2], "doc_id bigint, text string, item_id int, shard int")
    ev = spark.createDataFrame([(i, t, "s", "val", 1) for i, t in evals], "item_id bigint, text string, item_set string, split string, n_docs int")
    found = leak_index.leaks(df, ev, 12, shard_words=shard)
    got = [(r.item_id, r.doc_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, evals, 12)
    report = leak_index.leak_report(found, ev).first()
    assert report.n_items == len(evals) and report.n_pairs == len(got)


def test_retrieval_finds_all_over_the_threshold():
    rng = random.Random(9)
    items = [(i, [f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randint(12, 50))]) for i in range(150)]
    index = leak_index.Index(items, 12, block=4)
    for _ in range(60):
        terms = list({f"w{int(rng.random() ** 2 * 60)}" for _ in range(40)} & set(index.docs))
        score = {}
        for t in terms:
            for d, s in zip(index.docs[t], index.score[t]):
                score[d] = score.get(d, 0) + s
        assert set(index.retrieve(terms)) >= {d for d, s in score.items() if s >= 1.0 + 1e-9}
        assert set(index.retrieve(terms)) <= {d for d, s in score.items() if s >= 1.0 - 1e-9}


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leak_index.leaks(docs, none).count() == 0
    assert leak_index.leaks(docs.limit(0), spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")).count() == 0


def test_syllables():
    # Hand-counted syllables.
    known = {"the": 1, "cat": 1, "make": 1, "making": 2, "table": 2, "little": 2, "created": 3, "idea": 3, "area": 3, "studio": 3, "wanted": 2, "walked": 1, "boxes": 2, "plates": 1, "beautiful": 3, "movement": 2, "infection": 3, "irrigation": 4, "physiological": 6, "strawberry": 3, "nation": 2, "queue": 1, "people": 2}
    off = {w: readability.syllables(w) for w, n in known.items() if abs(readability.syllables(w) - n) > 0}
    assert len(off) <= 3, off
    assert sum(readability.syllables(w) for w in known) == pytest.approx(sum(known.values()), abs=3)


def test_sentences():
    cut = lambda t: [s.strip() for s in readability.sentences(t)]
    assert cut("One. Two! Three?\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert len(cut("See Fig. 3 (cf. Tab. 4) at approx. 2.5 mm, i.e. near J. Smith.")) == 1
    assert cut("  \n\n ") == []


SPEECH = {
    "en": "The children walked along the river until they found an old wooden bridge. Nobody knew who had built it. They sat down and watched the water while the evening light faded over the hills.",
    "de": "Die Kinder gingen am Fluss entlang, bis sie eine alte Brücke aus Holz fanden. Niemand wusste, wer sie gebaut hatte. Sie setzten sich und sahen dem Wasser zu, während das Licht über den Hügeln verschwand.",
    "fr": "Les enfants marchaient le long de la rivière jusqu'à ce qu'ils trouvent un vieux pont de bois. Personne ne savait qui l'avait construit. Ils se sont assis et ont regardé l'eau pendant que la lumière du soir disparaissait.",
    "it": "I bambini camminavano lungo il fiume finché trovarono un vecchio ponte di legno. Nessuno sapeva chi lo avesse costruito. Si sedettero e guardarono l'acqua mentre la luce della sera svaniva sulle colline.",
}


def model(spark, known=0.2):
    codes = {"en": ["en", "EN ", "en-GB", "eng"], "de": ["de", "ger", "DE", "deu"], "fr": ["fr", "fr_CA", "fra", "FR"], "it": ["it"] * 4}
    rows = [(text, c) for k, text in SPEECH.items() for c in codes[k]] + [(SPEECH["en"], "de"), (SPEECH["it"], None), (None, "en"), (SPEECH["it"], "pt"), ("", "??")]
    return readability.fit_languages(spark.createDataFrame(rows, "text string, lang string"), least=3, known=known)


def test_languages(spark):
    m = model(spark)
    assert m.names == ["de", "en", "fr", "it"]
    say = lambda t: readability.grades(t, m)[0]
    assert say("The farmers found the old house near the water and they sat there.") == "en"
    assert say("Niemand wusste, wer die alte Brücke am Wasser gebaut hatte, und sie gingen.") == "de"
    assert say("Les enfants ont trouvé la maison et personne ne savait pendant la soirée.") == "fr"
    assert say("Nessuno sapeva chi fosse il vecchio, e i bambini guardarono le colline.") == "it"
    assert say("Дети шли вдоль реки") is None and say("") is None and say("12 34") is None
    assert readability.fit_languages(spark.createDataFrame([], "text string, lang string")).names == []
    assert readability.grades("The cat.", readability.Languages([], {}, ()))[0] is None


def test_wrong_code_of_one_kind_of_text_is_no_language(spark):
    hard = "The methodological significance of the physiological deterioration was established experimentally, and the relationship between the conditions and the contamination of the sample is provisional."
    rows = [(SPEECH["en"], "en")] * 30 + [(hard, "en")] * 12 + [(hard, "pt")] * 12 + [(SPEECH["it"], "it")] * 9
    m = readability.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert m.names == ["en", "it"]
    assert readability.grades(hard, m)[0] == "en" and readability.grades(SPEECH["it"], m)[0] == "it"


def test_long_text_of_a_wrong_code_draws_no_texts_there(spark):
    hard = ["The methodological significance of the physiological deterioration was established experimentally.", "Heterogeneous contamination of the photographic collection invalidates the provisional differentiation.", "Insufficient illumination compromises the epidemiological classification of the neighbouring populations."]
    long = " ".join(hard * 40)
    rows = [(SPEECH["en"], "en")] * 60 + [(h, "en") for h in hard] * 3 + [(SPEECH["it"], "it")] * 10 + [(SPEECH["de"], "de")] * 10 + [(long, "it"), (SPEECH["de"], "en")]
    m = readability.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert m.names == ["de", "en", "it"]
    assert [readability.grades(t, m)[0] for t in [*hard, long, SPEECH["it"], SPEECH["de"]]] == ["en"] * 4 + ["it", "de"]


def test_mislabelled():
    having = {"the": {"en": 90, "es": 2}, "ledger": {"en": 3, "es": 1}, "el": {"es": 9}, "odd": {"es": 1}}
    assert readability.mislabelled(["the", "ledger", "odd"], "es", having)  # the row itself has no vote, nor has a word of no other row
    assert not readability.mislabelled(["the", "ledger", "odd", "el"], "es", having)
    assert not readability.mislabelled(["the", "ledger"], "en", having) and not readability.mislabelled([], "en", having)


def test_rated(spark):
    levels = spark.createDataFrame([(i, "en", float(i)) for i in range(10)] + [(90, "de", 3.0), (91, "en", None)], "doc_id bigint, language string, grade double")
    labels = [(i, r, 1 + i // 5) for i in range(10) for r in ("a", "b")] * 2 + [(0, "c", 5), (90, "a", 1), (91, "a", 1), (None, "a", 1), (3, "a", None)]
    got = {r.read_level: (r.n_docs, r.mean_grade, r.mean_rank) for r in readability.rated(levels, spark.createDataFrame(labels, "doc_id bigint, rater string, read_level int")).collect()}
    assert got == {1: (5, 2.0, 0.25), 2: (5, 7.0, 0.75)}


def test_reading_levels(spark):
    spoken = model(spark, 0.05)
    easy = "The cat sat. The dog ran. We saw it. It was fun. " * 5
    hard = "Notwithstanding considerable methodological heterogeneity, the multidisciplinary investigators substantiated that physiological deterioration of the reproductive structures necessitates comprehensive reconsideration of the agricultural recommendations that international organisations previously disseminated. " * 3
    rows = [(1, easy), (2, hard), (3, None), (4, ""), (5, "<p></p> &amp; 12 34"), (6, "Der Hund und die Katze sind im Haus, aber der Garten ist leer."), (7, hard.replace(" ", "\n")), (8, easy * 3000), (2, hard), (None, easy)]
    df = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], "doc_id bigint, text string, grade double, language string")
    levels = readability.reading_levels(df, spoken)
    got = {r.doc_id: r for r in levels.collect()}
    assert len(levels.collect()) == len(rows)
    assert got[1].grade < 4 < 16 < got[2].grade and got[1].language == got[2].language == "en"
    assert got[3].grade is None and got[4].language is None and got[5].grade is None
    assert got[6].language == "de"
    assert got[7].n_sentences > 50 > got[2].n_sentences and got[8].n_sentences == 60_000
    assert sorted(r.doc_id for r in readability.demanding(levels).collect()) == [2, 7]
    assert sum(r.n_docs for r in readability.level_profile(levels).collect()) == len(rows)
    assert readability.reading_levels(df.limit(0)).count() == 0 and readability.reading_levels(df).where("language IS NOT NULL").count() == 0
