import pytest
from pyspark.sql import functions as F

from docmill.functions import text, tokens, variant


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **values):
    data = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return data.select(column).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [("  a b \n", "a b"), (" x　", "x"), (" ", ""), ("", ""), (None, None), ("\x1fa", "a")],
)
def test_strip_takes_white_space_of_any_kind(spark, raw, clean):
    assert one(spark, text.strip("t"), t=raw) == clean


def test_question_key_ignores_case_punctuation_digits_and_spacing(spark):
    asked = ["What is  X-1?", "what is x", "WHAT is X!!! 22", "٢ what is x"]
    data = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r[0] for r in data.select(text.question_key("q")).collect()} == {"what is x"}


@pytest.mark.parametrize(
    "raw, content",
    [
        ("a <t> x </t> b <t>y</t>", "x"),
        ("a <t> open to the end", "open to the end"),
        ("<t></t> rest", ""),
        ("nothing", ""),
        (None, ""),
    ],
)
def test_tag_content(spark, raw, content):
    assert one(spark, text.tag_content("t", "t"), t=raw) == content


def test_closed_tag_needs_both_ends(spark):
    assert one(spark, text.closed_tag("t", "x"), t="<x  > a </x>") == "a"
    assert one(spark, text.closed_tag("t", "x"), t="<x> a") is None


def test_fence_is_stripped_only_around_the_whole(spark):
    assert one(spark, text.without_fence(F.col("t")), t="```json\n[1]\n```") == "[1]"
    assert one(spark, text.without_fence(F.col("t")), t="say ```x```") == "say ```x```"


def test_render_fills_in_one_pass_and_refuses_what_it_cannot_fill(spark):
    got = one(spark, text.render("{{a}} {x} {y}", x=F.col("x"), y=F.lit("1")), x="{y}")
    assert got == "{a} {y} 1"
    with pytest.raises(KeyError):
        text.render("{missing}", x=F.lit(""))
    with pytest.raises(ValueError):
        text.render("{x} }", x=F.lit(""))


def test_safe_id(spark):
    data = spark.createDataFrame([("a b/c_1-2", 1), ("!!", 7), (None, 9)], "d string, n int")
    assert [r[0] for r in data.select(text.safe_id("d", F.col("n"))).collect()] == ["abc_1-2", "doc_7", "doc_9"]


def test_token_counts_and_messages(spark):
    assert one(spark, tokens.token_count("t"), t=" a  b\tc\n") == 3
    assert one(spark, tokens.token_count("t"), t=None) == 0
    chat = F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
    assert one(spark, tokens.message_tokens(chat), t="two words") == 3 + 3 + 1 + 2
    assert one(spark, tokens.token_count("t", "byte_bpe_50k"), t="hello world") == 2


def items(spark, raw):
    found = spark.createDataFrame([(raw,)], "r string").select(F.explode(variant.response_items("r")).alias("i"))
    return [r[0] for r in found.select(F.to_json("i")).collect()]


@pytest.mark.parametrize(
    "raw, count",
    [
        ('<output_json>[{"q": 1}]</output_json>', 1),
        ('<output_json>```json\n[{"q": 1}, {"q": 2}]\n```</output_json>', 2),
        ('text ```json\n[{"q": 1}]\n``` more', 1),
        ('<output_json>{"q": 1}</output_json>', 0),
        ('<output_json>{"q": 1}</output_json> ```json\n[{"q": 2}]\n```', 1),
        ('<output_json>[{"q": 1</output_json>', 0),
        ("scalars [1, 2] here", 2),
        ("", 0),
        (None, 0),
    ],
)
def test_the_list_of_a_response(spark, raw, count):
    assert len(items(spark, raw)) == count


@pytest.mark.parametrize(
    "raw, level",
    [
        ('{"difficulty": "Hard"}', 7),
        ('{"complexity": "odd"}', 5),
        ('{"estimated_difficulty": 7.9}', 7),
        ('{"estimated_difficulty": 99}', 10),
        ('{"estimated_difficulty": "7"}', 5),
        ('{"estimated_difficulty": -3}', 1),
        ('{"estimated_difficulty": null}', 5),
        ("{}", None),
    ],
)
def test_difficulty(spark, raw, level):
    parsed = spark.createDataFrame([(raw,)], "r string").select(F.try_parse_json("r").alias("i"))
    assert parsed.select(variant.difficulty(F.col("i"), variant.keys_of(F.col("i")))).first()[0] == level


def test_aliases_and_custom_fields(spark):
    raw = '{"explanation": "e", "reasoning": "r", "topic": "t", "citations": "no list"}'
    parsed = spark.createDataFrame([(raw,)], "r string").select(F.try_parse_json("r").alias("i"))
    keys = variant.keys_of(F.col("i"))
    got = parsed.select(
        variant.aliased(F.col("i"), keys, "thought_process"), variant.custom_fields(F.col("i")), variant.text_list(F.col("i"), "citations")
    ).first()
    assert tuple(got) == ("r", {"topic": "t"}, [])


def test_written_intermediates_are_deleted_and_a_cluster_must_name_their_folder(spark):
    import glob

    from docmill import session

    written = session.cut_lineage(spark.range(10))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    session.discard(written)
    session.discard(spark.range(3))
    assert len(before - set(glob.glob(f"{folder}/rdd-*"))) == 1

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
            getConf = staticmethod(dict)  # noqa: N815

        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster)


def test_written_tables_keep_their_partitioning(spark):
    from docmill import session

    written = session.partitioned_by(spark.createDataFrame([(i % 7, "x") for i in range(30)], "id long, t string"), "id")
    assert sorted(r.id for r in written.collect()) == list(range(7))
    plan = written.join(spark.range(5).hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
