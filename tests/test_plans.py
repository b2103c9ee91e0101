import base64
import io
import json
import os
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import schemas
from docmill.__main__ import main, stub
from docmill.operators import inference, metrics
from docmill.plans import card, config, prompts, schema_prompt
from docmill.plans.pipeline import Pipeline
from docmill.sources import chat, convert, files
from docmill.sources.hub import FolderHub
from docmill.sources.store import SubsetStore
from docmill.streaming import ingest


def test_files_texts_and_ingestion(spark, tmp_path):
    root = tmp_path / "raw"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text(" Bullet • euro € \n", encoding="utf-8")
    (root / "sub" / "b.html").write_text("<html><body><h1>T</h1><p>x &amp; y</p><!-- no --><script>no</script></body></html>")
    (root / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (root / "blank.md").write_text("  \n")
    (root / "c.bin").write_text("x")
    (root / "output.md").write_text("left out")
    found = files.files(spark, str(root), (".txt", ".html", ".md"))
    got = {r.document_filename: r for r in files.ingested(files.texts(found)).collect()}
    assert set(got) == {"a.txt", "b.html"}
    assert got["a.txt"].document_text == "Bullet • euro €" and got["a.txt"].document_metadata.file_size == len("Bullet • euro €".encode())
    assert got["b.html"].document_text == "# T\n\nx & y"


def test_html_keeps_tables_and_lists():
    page = "<nav>menu</nav><ul><li>a</li><li>b</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2|3</td></tr></table><a href='u'>l</a>"
    text = convert.html_to_markdown(page)
    assert "menu" not in text and "- a\n- b" in text and "| k | v |\n|---|---|\n| 1 | 2\\|3 |" in text and "[l](u)" in text
    assert convert.html_to_markdown("<nav>menu<p>Body text") == "menu\n\nBody text" and convert.html_to_markdown("<head><title>t</title><p>Body") == "Body"
    assert convert.html_to_markdown("<head><title>t</title></head><nav><ul><li>m</ul></nav><p>Body</p><footer>f</footer>") == "Body"
    assert convert.html_to_markdown("") is None and convert.html_to_markdown("<script>x</script>") is None


def test_converters_and_pages(spark):
    df = spark.createDataFrame([(".x", bytearray(b"abc")), (".y", bytearray(b"abc")), (".z", None)], "extension string, content binary")
    table = {".x": lambda b: b.decode().upper(), ".y": lambda b: 1 / 0}
    assert [r[0] for r in df.select(convert.converted(F.col("extension"), F.col("content"), table)).collect()] == ["ABC", None, None]
    pages = spark.createDataFrame([("p", 1, 0, "two"), ("p", 0, 1, "one"), ("p", 0, 0, " ")], "path string, model_order int, page int, text string")
    assert files.joined_pages(pages).first().text == "one\n\n---\n\ntwo"


def zipped(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name.replace("__", "/") + ".xml", text)
    return data.getvalue()


def test_office_files_are_read(spark, tmp_path):
    w = '<w:document xmlns:w="x"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>'
    slide = lambda t: f'<p:sld xmlns:p="y" xmlns:a="z"><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sld>'
    sheet = '<worksheet xmlns="s"><sheetData><row><c t="s"><v>1</v></c><c><v>7</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="s"><si><t>no</t></si><si><r><t>k</t></r><r><t>ey</t></r></si></sst>'
    for name, data in {
        "a.docx": zipped(word__document=w), "b.pptx": zipped(ppt__slides__slide2=slide("second"), ppt__slides__slide10=slide("tenth"), ppt__slides__slide1=slide("first")),
        "c.xlsx": zipped(xl__worksheets__sheet1=sheet, xl__sharedStrings=shared), "d.docx": b"no archive",
    }.items():
        (tmp_path / name).write_bytes(data)
    read = files.texts(files.files(spark, str(tmp_path), (".docx", ".pptx", ".xlsx")))
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in read.collect()}
    assert got == {"a.docx": "One two\n| a\\|b |  |\nEnd", "b.pptx": "first\nsecond\ntenth", "c.xlsx": "| key | 7 |\n| x |"}


def test_store_replaces_appends_and_overwrites_itself(spark, tmp_path):
    store = SubsetStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError, match="none"):
        store.load("ingested")
    assert store.load("ingested", optional=True).schema == schemas.INGESTED
    store.save(spark.createDataFrame([(1, "é")], "id int, text string"), "t")
    store.save(spark.createDataFrame([(2, None)], "id int, text string"), "t", append=True)
    assert store.load("t").count() == 2
    store.save(store.load("t").withColumn("id", F.col("id") + 10), "t")
    assert sorted(r.id for r in store.load("t").collect()) == [11, 12]
    os.rename(tmp_path / "s" / "t", tmp_path / "s" / "_former_t")  # as if a replacement had been broken off
    assert store.subsets() == ["t"] and store.load("t").count() == 2
    store.save(spark.createDataFrame([(1,)], "other int"), "t", append=True)
    assert store.load("t").columns == ["other"]
    store.save(spark.createDataFrame([], "id int"), "u")
    assert store.export_jsonl(str(tmp_path / "j")) == {"subsets": {"t": 1, "u": 0}, "total_rows": 1}


def test_configuration_is_checked(monkeypatch):
    monkeypatch.setenv("SOME_NAME", "ds")
    made = config.parse({"models": [{"model_name": "m", "max_concurrent_requests": 2}], "hf_configuration": {"dataset_name": "$SOME_NAME", "organization": "o"}, "pipeline": {"chunking": None, "ingestion": {"run": False}}})
    assert made.enabled() == ["chunking"] and made.roles["chunking"] == ["m"] and made.storage.identifier() == "o/ds"
    for bad in ({"pipeline": {"odd": {}}}, {"pipeline": {"chunking": {"h_min": 3, "h_max": 2}}}, {"pipeline": {"citation_score_filtering": {"alpha": 2}}},
                {"pipeline": {"single_shot_question_generation": {"question_mode": "x"}}}, {"pipeline": {"cross_document_question_generation": {"num_docs_per_combination": [1, 2]}}}, {"model_list": [{}]}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    with pytest.raises(ValueError):
        config.parse({"model_list": [{"model_name": "m", "max_concurrent_requests": 0}]})


FULL = """
hf_configuration: {hf_dataset_name: made, hf_organization: $SOME_ORGANIZATION, private: true, push_to_hub: false, upload_card: false}
models:
  - {model_name: a/b, base_url: "http://localhost:1/v1", api_key: $SOME_KEY, max_concurrent_requests: 8, provider: x, bill_to: y}
  - {model_name: c, api_key: written-out}
model_roles: {summarization: [c]}
debug: true
pipeline_config:
  ingestion: {source_documents_dir: raw, output_dir: out, llm_ingestion: true, pdf_dpi: 150, upload_to_hub: false}
  summarization:
  chunking: {l_max_tokens: 1024, token_overlap: 256, h_min: 2}
  single_shot_question_generation: {question_mode: " Multi-Choice", single_shot_system_prompt: one, single_shot_system_prompt_multi: many, chunk_sampling: {enable: true, num_samples: 7, strategy: random, random_seed: 3}}
  multi_hop_question_generation: {question_mode: "", multi_hop_system_prompt: hop, additional_instructions: Ask.}
  cross_document_question_generation: {cross_document_system_prompt: across, max_combinations: 10, num_docs_per_combination: [2, 4]}
  question_rewriting: {question_rewriting_user_prompt: again}
  prepare_lighteval:
  citation_score_filtering:
"""


def test_a_file_with_every_key_is_read(tmp_path, monkeypatch, caplog):
    monkeypatch.setenv("SOME_ORGANIZATION", "org")
    monkeypatch.setenv("SOME_KEY", "sk-secret-of-mine")
    (tmp_path / "c.yaml").write_text(FULL)
    made = config.load(str(tmp_path / "c.yaml"))
    assert not caplog.records and made.enabled() == list(config.STAGES) and made.storage.identifier() == "org/made" and made.debug
    first, second = made.models
    assert (first.key_variable, first.api_key, first.concurrency, first.provider) == ("SOME_KEY", None, 8, "x") and second.api_key == "written-out"
    assert "sk-secret" not in repr(made) and "written-out" not in repr(made) and "written-out" not in card.render_card(made)
    assert made.roles["summarization"] == ["c"] and made.roles["chunking"] == ["a/b"]
    stages = made.stages
    single = stages["single_shot_question_generation"]
    assert single.question_mode == "multi-choice" and single.system() == "many" and (single.sampling().mode, single.sampling().value, single.sampling().seed) == ("count", 7, 3)
    assert stages["multi_hop_question_generation"].system() == "hop" and stages["cross_document_question_generation"].system() == "across"
    assert stages["question_rewriting"].user_prompt == "again" and stages["ingestion"].pdf_dpi == 150 and stages["chunking"].token_overlap == 256
    config.parse({"pipeline": {"chunking": {"no_such": 1}}, "model_list": [{"model_name": "m", "odd": 1}]})
    assert [r.getMessage() for r in caplog.records] == ["model m: unknown keys odd are ignored", "chunking: unknown keys no_such are ignored"]
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert config.parse({}).models[0].key_variable == "OPENAI_API_KEY"
    with pytest.raises(config.ConfigError):
        config.parse({"pipeline": {"single_shot_question_generation": {"chunk_sampling": {"num_samples": 0}}}})


def test_models_are_asked_over_http_within_their_concurrency(spark):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen, under_way, most, lock = [], [0], [0], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                under_way[0] += 1
                most[0] = max(most[0], under_way[0])
                seen.append((body, self.headers["Authorization"]))
            time.sleep(0.05)
            said = body["messages"][-1]["content"]
            code = {"denied": 401, "often": 429, "broken": 500}.get(str(said), 200)
            reply = {"choices": []} if said == "empty" else {"choices": [{"message": {"content": f"{body['model']} {said}"}}]}
            data = json.dumps(reply).encode()
            with lock:
                under_way[0] -= 1
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1/"
        model = inference.Model("m", url, concurrency=2, extra={"temperature": 0}, api_key="mine")
        prompts_ = ["denied", "often", "broken", "empty", *[f"p{i}" for i in range(30)]]
        calls = spark.createDataFrame([(i, p) for i, p in enumerate(prompts_)], "id int, prompt string")
        turns = F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
        got = {r.prompt: r for r in inference.answers(calls.withColumn("messages", turns), [model], chat.HttpChat(), attempts=1, tasks=4).collect()}
        assert {p: r.response for p, r in got.items() if r.success} == {f"p{i}": f"m p{i}" for i in range(30)}
        assert {p: r.error_type for p, r in got.items() if not r.success} == {"denied": "AuthenticationError", "often": "RateLimitError", "broken": "RuntimeError", "empty": "RuntimeError"}
        assert most[0] <= 2 and all(b["temperature"] == 0 and b["messages"][0]["content"] == "be brief" and key == "Bearer mine" for b, key in seen)
        assert chat.HttpChat().chat(model, [{"role": "user", "content": "x"}], "aW1n").startswith("m [")
        with pytest.raises(ConnectionError):
            chat.HttpChat("http://127.0.0.1:9/v1")(inference.Model("m"), "x")
        with pytest.raises(ValueError):
            chat.HttpChat()(inference.Model("m"), "x")
    finally:
        server.shutdown()


def test_prompts_and_schemas(tmp_path):
    (tmp_path / "p.md").write_text("from a file")
    assert prompts.load_prompt(str(tmp_path / "p.md"), "summary") == "from a file"
    assert prompts.load_prompt("", "summary") == prompts.SUMMARY and prompts.load_prompt("a\nb", "summary") == "a\nb" and prompts.load_prompt("short", "summary") == "short"
    schema = schema_prompt.default_schema("multi-choice")
    text = schema_prompt.system_prompt("X {schema_definition} Y {example_output} Z {critical_reminders}", schema)
    wanted = json.loads(text.split("```json")[1].split("```")[0])["items"]
    assert wanted["properties"]["answer"]["enum"] == ["A", "B", "C", "D"] and wanted["properties"]["choices"]["minItems"] == 4 and "choices" in wanted["required"]
    item = json.loads(text.split("Y <output_json>")[1].split("</output_json>")[0])[0]
    assert 1 <= item["estimated_difficulty"] <= 10 and len(item["choices"]) == 4 and set(item) == set(schema.names)
    assert schema_prompt.system_prompt("plain", schema) == "plain"
    with pytest.raises(ValueError):
        schema_prompt.default_schema("x")


def test_custom_schemas_come_from_files(tmp_path):
    spark_types = T.StructType([T.StructField("question", T.StringType(), False, {"comment": "c"}), T.StructField("steps", T.ArrayType(T.LongType()), True, {"min_items": 2}), T.StructField("more", T.StructType([T.StructField("a", T.DoubleType())]))])
    assert schema_prompt.spark_schema(schema_prompt.json_schema(spark_types)).simpleString() == spark_types.simpleString()
    files = {
        "a.json": json.dumps(schema_prompt.json_schema(spark_types)),
        "b.json": spark_types.json(),
        "c.py": "DataFormat = 'question string, steps array<bigint>, more struct<a: double>'",
        "d.py": "class DataFormat:\n    @staticmethod\n    def model_json_schema():\n        return {'$ref': '#/$defs/Q', '$defs': {'Q': {'type': 'object', 'properties': {'question': {'type': 'string'},"
        " 'steps': {'anyOf': [{'type': 'array', 'items': {'type': 'integer'}}, {'type': 'null'}]}, 'more': {'$ref': '#/$defs/M'}}}, 'M': {'type': 'object', 'properties': {'a': {'type': 'number'}}}}}",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        assert schema_prompt.load_schema(str(tmp_path / name), "open-ended").simpleString() == spark_types.simpleString()
    assert schema_prompt.load_schema(None, "open-ended") == schema_prompt.default_schema("open-ended")
    (tmp_path / "e.py").write_text("x = 1")
    for bad in ("e.py", "none.py"):
        with pytest.raises(schema_prompt.SchemaError):
            schema_prompt.load_schema(str(tmp_path / bad), "open-ended")


def test_card_hides_secrets():
    made = config.parse({"model_list": [{"model_name": "m", "base_url": "http://x", "extra_parameters": {"k": "sk-abcdefghijkl"}}], "pipeline": {"chunking": {}}})
    text = card.render_card(made, "---\na: 1\ndataset_info:\n  x: 2\nb: 3\n---\nold")
    assert "sk-abc" not in text and "http://x" not in text and "**chunking**" in text and text.startswith("---\ndataset_info:\n  x: 2\n---")


def test_pages_are_rendered_transcribed_and_ingested(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_RENDERERS", {".pdf": lambda data, dpi: [f"{dpi}:{x}".encode() for x in data.decode().split("|")]})
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.pdf").write_bytes(b"one|two")
    (raw / "b.pdf").write_bytes(b"\xff\xfe")
    (raw / "c.txt").write_text("plain")

    class Reader:
        def chat(self, model, messages, image=None):
            return f"{model.name} read {base64.b64decode(image).decode()}"

    made = config.parse({"hf_configuration": {"local_dataset_dir": str(tmp_path / "s")}, "model_list": [{"model_name": "m", "encoding_name": "word"}], "pipeline": {"ingestion": {"source_documents_dir": str(raw), "output_dir": "", "llm_ingestion": True, "pdf_dpi": 90}}})
    Pipeline(spark, made, Reader()).run()
    got = {r.document_filename: r.document_text for r in SubsetStore(spark, str(tmp_path / "s")).load("ingested").collect()}
    assert got == {"a.pdf": "m read 90:one\n\n---\n\nm read 90:two", "c.txt": "plain"}


def test_whole_pipeline(spark, tmp_path):
    class Hinting:
        """The stub, that adds the fields of a custom schema where the system prompt asks for them."""

        def chat(self, model, messages, image=None):
            answer = stub(model, messages[-1]["content"])
            wants = any('"hint"' in m["content"] and "JSON Schema" in m["content"] for m in messages if m["role"] == "system")
            return answer.replace('"question_type"', '"hint": "look twice", "steps": [1, 2], "question_type"') if wants else answer

    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(3):
        (raw / f"d{i}.txt").write_text(" ".join(f"w{i}x{j}" for j in range(40 + 10 * i)))
    made = config.parse(
        {
            "hf_configuration": {"dataset_name": "t", "local_dataset_dir": str(tmp_path / "store"), "export_jsonl": True, "jsonl_export_dir": str(tmp_path / "jsonl")},
            "model_list": [{"model_name": "m", "encoding_name": "word"}],
            "pipeline": {
                "ingestion": {"source_documents_dir": str(raw), "output_dir": str(tmp_path / "md")},
                "summarization": {"max_tokens": 30, "token_overlap": 5, "encoding_name": "word"},
                "chunking": {"l_max_tokens": 16, "token_overlap": 0, "encoding_name": "word"},
                "single_shot_question_generation": {"question_schema": str(tmp_path / "schema.py")},
                "multi_hop_question_generation": {},
                "cross_document_question_generation": {"max_combinations": 3},
                "question_rewriting": {},
                "prepare_lighteval": {},
                "citation_score_filtering": {},
            },
        }
    )
    (tmp_path / "schema.py").write_text("DataFormat = 'question string not null, answer string, hint string, steps array<int>'")
    hub = FolderHub(spark, str(tmp_path / "hub"))
    took = Pipeline(spark, made, Hinting(), hub).run()
    other = Pipeline(spark, config.parse({"hf_configuration": {"dataset_name": "t", "local_dataset_dir": str(tmp_path / "elsewhere")}}), Hinting(), hub)
    assert other.load("chunked").count() == 3 and (tmp_path / "hub" / "t" / "README.md").exists()
    with pytest.raises(FileNotFoundError):
        other.load("nowhere")
    assert list(took) == made.enabled()
    store = SubsetStore(spark, str(tmp_path / "store"))
    prepared = store.load("prepared_lighteval")
    assert {r.kind for r in prepared.select("kind").distinct().collect()} == {"single_shot", "multi_hop", "cross_document"}
    assert prepared.where("citation_score > 0").count() > 0
    assert store.load("single_shot_questions_rewritten").where("original_question IS NULL").count() == 0
    totals = spark.read.option("header", True).csv(f"{store.root}/_calls/totals").collect()
    calls = spark.read.schema(metrics.LOG).option("header", True).csv(f"{store.root}/_calls/log")
    assert [(r.model_name, int(r.total_calls)) for r in totals] == [("m", calls.count())] and calls.where("input_tokens > 0 AND output_tokens > 0 AND encoding_used = 'word'").count() == calls.count()
    assert {r.stage for r in calls.select("stage").distinct().collect()} == {"summarization", "question_rewriting", *(f"{k}_question_generation" for k in ("single_shot", "multi_hop", "cross_document"))}
    assert {tuple(sorted(r.custom_fields.items())) for r in prepared.where("kind = 'single_shot'").select("custom_fields").collect()} == {(("hint", "look twice"), ("steps", "[1,2]"))}
    assert (tmp_path / "md").exists() and os.path.exists(tmp_path / "jsonl" / "index.json") and os.path.exists(tmp_path / "store" / "README.md")


def test_command_line(capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    with pytest.raises(SystemExit):
        main(["run", "x.txt"])


def test_streams(spark, tmp_path):
    schema = ingest.CALLS
    rows = [(1, "2024-01-01", 5), (1, "2024-01-01", 5), (2, "2024-01-02", -7), (3, "2024-01-20", 1)]
    calls = spark.createDataFrame(rows, "call_id long, t string, input_tokens long").select("call_id", F.to_timestamp("t").alias("logged_at"), F.lit("M").alias("model_name"), F.lit("s").alias("stage"), "input_tokens", F.lit(1).cast("long").alias("output_tokens"), F.lit("w").alias("encoding_used"))
    calls.write.parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.first_calls(ingest.table_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    ingest.run_available(ingest.cost_windows(ingest.table_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "w"), str(tmp_path / "ck2"))
    got = {str(r.window.start)[:10]: (r.input_tokens, r.calls) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got["2024-01-01"] == (5, 1) and got["2024-01-02"] == (0, 1)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    ingest.run_available(ingest.new_files(spark, str(tmp_path / "f")).select("path", "length"), str(tmp_path / "fo"), str(tmp_path / "ck3"))
    assert spark.read.parquet(str(tmp_path / "fo")).count() == 1
