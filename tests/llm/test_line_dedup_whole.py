"""The whole job of line dedup on small frames: what a count of documents is, which lines take part, templates of a leaf."""

from netloom.llm import line_dedup

SCHEMA = "doc_id long, text string"


def kept(spark, texts):
    return {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def test_shared_passages_count_documents(spark):
    passage = "\n".join(f"shared passage {c} of ten documents" for c in "abcdefghijklmnopqrst")
    own = [f"only document {c} has this" for c in "abcdefghij"]
    assert kept(spark, [f"{passage}\n{o}" for o in own]) == dict(enumerate(own))


def test_documents_of_templates_only_and_exact_copies(spark):
    logs = [f"Served {i} users in {i + 1} ms today.\nClosed {i} of {i + 2} open handles now." for i in range(6)]
    assert set(kept(spark, logs).values()) == {""}
    copies = ["some text that was copied\nwith a second line here"] * 9
    assert kept(spark, copies) == dict(enumerate(copies))


def test_a_leaf_has_as_many_templates_as_it_needs(spark):
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove"]
    hot = "The user has been logged out by timeout"
    texts = [f"{hot}\nThe user has opened file {w} in editor\nThe user has closed {w} tabs without saving\nThe user has {w} quite alone here {w}" for w in words]
    assert kept(spark, texts) == {i: f"The user has {w} quite alone here {w}" for i, w in enumerate(words)}
    assert kept(spark, texts[:4]) == dict(enumerate(texts[:4]))


def test_short_lines_go_as_exact_templates_in_the_pipeline(spark):
    import corpus_pipeline as P

    def left(texts):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        return {r.doc_id: r.text for r in P.template_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}

    short = ["Les.", "And ornd.", "版权所有。", "版权所有2024年。", "me@example.com"]
    stay = ["", "  ", "42", "3 4"]
    own = [f"only document {c} has this" for c in "abcdef"]
    assert left(["\n".join([*short, *stay, o]) for o in own]) == {i: "\n".join([*stay, o]) for i, o in enumerate(own)}
    four = ["Les.\nonly here", "Les.\nand there", "Les.\nor elsewhere", "Les.\nor nowhere"]
    assert left(four) == dict(enumerate(four))


def test_one_place_varies_in_lines_of_any_length(spark):
    base = [f"tok{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    lines = []
    for i, at in enumerate([7] * 6 + [90, 200]):  # six lines differ in one place, two others in places of their own
        tokens = base[:3] + [w + "x" * (i // 6) for w in base[3:]]
        tokens[at] = "vary" + "abcdefgh"[i]
        lines.append(" ".join(tokens))
    far = ["tokaa tokba tokca " + " ".join(f"other{c}{chr(97 + j % 26)}" for j in range(397)) for c in "pqrstuv"]
    got = kept(spark, [f"{line}\nrest of {chr(97 + i)} here" for i, line in enumerate(lines + far)])
    gone = {i for i, t in got.items() if "\n" not in t}
    assert gone >= set(range(6)) and not gone & set(range(8, 15))
    long = kept(spark, ["word " * 30_000 + c for c in "abc"])  # a place of a long line costs two numbers
    assert len(long) == 3 and all(t.startswith("word") for t in long.values())
