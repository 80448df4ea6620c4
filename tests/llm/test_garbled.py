import random

import pytest

from maskmill.llm.charsets import chains, garble, page, plausible, undo
from maskmill.llm.garbled import candidates_of, garbled_records, repaired_records, restore, skeleton, stripped, units_of

SENTENCES = {
    "fr": ["Le réglage du gain a été noté par l’opératrice.", "La lésion très échogène mesure {} × {} mm.", "Vérifiez l’échelle avant de mesurer."],
    "de": ["Die Größe der Läsion wurde mit {} mm überschätzt.", "Für Bild {} fehlt die zweite Maske.", "Das Gerät zeigte {} dB zu viel Verstärkung."],
    "ru": ["Маска занимает {} % снимка {}.", "Глубина отличается от снимка {}.", "Усиление было {} дБ, затем датчик повернули."],
    "en": ["Pair {} – the naïve flip is safe.", "The cyst measures {} × {} mm at {} °C.", "Nothing to report in frame {}."],
}
TRAPS = ["If you meet sequences such as â€™ or Ã¼ in an old export, open a ticket {}.", "The reader typed ÃŸ on purpose to show line {}.", "Search the logs for the character � before blaming font {}."]
HOW = {"fr": ["utf-8>cp1252", "utf-8>mac-roman", "cp1252>mac-roman"], "de": ["utf-8>cp1252", "utf-8>cp850", "cp850>cp1252"], "ru": ["utf-8>cp1251", "koi8-r>cp1251", "utf-8>cp1252"], "en": ["utf-8>cp1252", "utf-8>cp1252>utf-8>cp1252"]}


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        lang = rng.choice(list(SENTENCES))
        say = lambda: rng.choice(SENTENCES[lang]).format(*[rng.randint(1, 99) for _ in range(3)])  # noqa: B023, E731
        parts = [say() for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.04:
            parts.append(rng.choice(TRAPS).format(rng.randint(1, 99)))
        sound = " ".join(parts)
        text = sound
        if rng.random() < 0.08:
            chain = rng.choice(HOW[lang])
            whole = rng.random() < 0.5
            read = [garble(p, chain) if whole or j == 0 else p for j, p in enumerate(parts)]
            if None not in read and " ".join(read) != sound:
                text = " ".join(read)
                truth[i] = sound
        rows.append((i, text, rng.choice(["a", "b", None]), "x"))
    return rows, truth


def test_chains_are_undone():
    for chain in chains():
        for text in ("prénom größe", "Маска снимка", "ağır şey", "próg łąka", "κάτω όριο"):
            read = garble(text, chain)
            if read is not None and read != text and len(set(page(chain.split(">")[1]))) == 256:
                assert undo(read, chain) == text, chain
    assert undo("plain", "utf-8>cp1252") is None and undo("é", "utf-8>cp1252") is None
    assert plausible("l’été") and plausible("21×19") and not plausible("pаper") and not plausible("a\x81b") and not plausible("m╡n")


def test_units():
    assert units_of(None) == units_of("") == units_of("only ascii 12") == set()
    assert units_of("(été) 21 × 19") == {"été", "×", "#\x1f×\x1f", "\x1f×\x1f#"}
    assert skeleton("prÃ©t") == skeleton("prét") == "pr?t"
    ways = {(c, k) for c, _, k, _ in candidates_of("aprÃ¨s")}
    assert ("utf-8>cp1252", "après") in ways and not any(k == "ÃŸ" for _, _, k, _ in candidates_of("ß"))


def test_dropped_controls(spark):
    """UTF-8 read as Latin-1 with the controls dropped is found through the sound unit."""
    assert stripped("reader’s") == "readerâs" and stripped("été") is None and stripped("a\x1f–\x1fb") == "a\x1fâ\x1fb"
    rows = [(i, f"The reader’s note {i} – fine.", "s") for i in range(80)] + [(100, "The readerâs note 7 â fine.", "s"), (101, "A câmara note 4.", "s")]
    out = repaired_records(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    assert [(r.doc_id, r.repaired) for r in out] == [(100, "The reader’s note 7 – fine.")]


def test_signs_around_a_word_and_characters_lost_for_good(spark):
    """Quotes of another code page around a word that is nowhere else quoted; a replacement
    character between digits, where no sound unit tells what it was."""
    assert units_of("ÒscarÓ") == {"ÒscarÓ", "Ò\x1eÓ"} and units_of("“a”") == {"“a”", "“\x1e”"} and units_of("été") == {"été"}
    words = ["edge", "rim", "shadow", "border", "cyst", "halo", "spot"]
    rows = [(i, f"The brush slipped over the “{words[i % 7]}” in image {i} – twice.", "s") for i in range(140)]
    rows += [(1000 + i, f"The brush slipped over the Ò{w}Ó in image {i}.", "s") for i, w in enumerate(("scar", "vessel", "node"))]
    rows += [(2000 + i, f"The rate falls from {i}\ufffd10 to nearly zero.", "s") for i in range(3)] + [(3000, "Search for the character \ufffd before blaming the font.", "s")]
    out = {r.doc_id: r.repaired for r in repaired_records(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert set(out) == {1000, 1001, 1002, 2000, 2001, 2002}
    assert out[1000] == "The brush slipped over the “scar” in image 0." and out[2001] == "The rate falls from 1\ufffd10 to nearly zero."


def test_restore():
    text, n = restore("aprÃ¨s 12 Ã— 3,\n(pr�s)  fin", {"aprÃ¨s": ("utf-8>cp1252", "après"), "#\x1fÃ—\x1f": ("utf-8>cp1252", "#\x1f×\x1f"), "pr�s": ("lost", "près")}, "utf-8>cp1252")
    assert text == "après 12 × 3,\n(près)  fin" and n == 3
    assert restore("", {}, "lost") == ("", 0) and restore("a" * 200_000, {}, "utf-8>cp1252")[1] == 0


def test_found_and_repaired(spark):
    """On invented texts with known damage, traps included."""
    rows, truth = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, chain string").repartition(3)
    out = {r.doc_id: r for r in repaired_records(df, "doc_id", "text", "source").collect()}
    hits = len(set(out) & set(truth))
    assert hits >= 0.95 * len(out) and hits >= 0.95 * len(truth), (hits, len(out), len(truth))
    right = sum(out[i].repaired == truth[i] for i in set(out) & set(truth))
    assert right >= 0.9 * hits, (right, hits)
    assert all(r.probability > 0.5 and r.garbled_tokens > 0 for r in out.values())


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, id string"
    rows = [(1, None, None, "q"), (2, "", "s", "q"), (3, "plain", "s", None), (None, "aprÃ¨s", "s", "q"), (4, "é " * 50_000, "s", "q"), (5, "x" * 100_000, None, "q"), (5, "x", "s", "q")]
    df = spark.createDataFrame(rows, schema)
    found, _ = garbled_records(df, "doc_id", "text", "source")
    assert found.collect() == []
    assert repaired_records(df.limit(0), "doc_id", "text", "source").collect() == []


@pytest.mark.parametrize("trap", TRAPS)
def test_quoted_signs_alone_are_sound(spark, trap):
    rows = [(i, f"La lésion mesure {i} × 3 mm. été", "s") for i in range(60)] + [(100, trap.format(4), "s")]
    found, _ = garbled_records(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert found.collect() == []


def test_copies_of_one_garbled_text(spark):
    """A third of all rows are copies of one garbled text; all of them are found and repaired."""
    rows, truth = corpus(600, 5)
    rows = [r[:3] for r in rows]
    sound = "Le réglage du gain a été noté par l’opératrice. Vérifiez l’échelle avant de mesurer."
    rows += [(10_000 + i, garble(sound, "utf-8>cp1252"), "a") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = {r.doc_id: r for r in repaired_records(df, "doc_id", "text", "source").collect()}
    assert all(i in out and out[i].repaired == sound for i in range(10_000, 10_300))
    hits = len(set(out) & set(truth))
    assert hits >= 0.9 * len(truth) and hits >= 0.9 * sum(i < 10_000 for i in out)


def test_source_garbled_throughout(spark):
    """A source that holds a third of all rows, each another text, all read in the wrong encoding."""
    rows, _ = corpus(400, 7)
    rng = random.Random(4)
    rows = [r[:3] for r in rows]
    say = lambda: " ".join(rng.choice(SENTENCES["fr"]).format(rng.randint(1, 99), rng.randint(1, 99)) for _ in range(5)) + f" {rng.random()}"
    rows += [(10_000 + i, garble(say(), "utf-8>cp1252"), "hot") for i in range(200)]
    found, _ = garbled_records(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "doc_id", "text", "source")
    assert sum(r.doc_id >= 10_000 for r in found.collect()) >= 190


@pytest.mark.parametrize("times", [1, 40])
def test_more_deliveries_change_nothing(spark, times):
    """A word that decodes as UTF-8 and is nowhere attested counts once per text."""
    bad = garble("préopératoire échogénicité hétérogène séparément éloignée médiolatérale", "utf-8>cp1252")
    rows = [(i, f"La lésion mesure {i} × 3 mm.", "s") for i in range(60)] + [(100 + i, bad, "s") for i in range(times)]
    found, _ = garbled_records(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert {r.doc_id for r in found.collect()} == {100 + i for i in range(times)}
