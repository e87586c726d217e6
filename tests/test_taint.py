"""Sources, sinks and flows in code, and candidates among functions."""

from lodeflow.functions import scalars
from lodeflow.operators import taint

JS = """const run = async (req, res) => {
  const id = req.body.user.id;
  const kept = cfg.req.body;
  db.query(`select ${id}`);
  res.send(id);
};
app.get('/x', (req, res) => {
  child.exec(req.query['cmd']);
});"""
PY = """def load(request):
    q = request.args.get('q')
    cursor.execute(f"select {q}")
def execute(self):
    budget(q)
    return open(request.form['name'])"""


def lines(spark):
    rows = [(1, JS, "javascript"), (2, PY, "python"), (3, None, "python"), (4, "", "go"), (5, "db.query(x)", None)]
    return taint.code_lines(spark.createDataFrame(rows, "k int, code string, lang string"), "k", "code", "lang")


def test_sources_and_their_functions(spark):
    found = {(r.k, r.line, r.expression, r.source_type, r.function) for r in taint.sources(lines(spark), "k").collect()}
    assert found == {
        (1, 2, "req.body.user.id", "request_body", "run"), (1, 8, "req.query['cmd']", "request_query", "__anonymous_handler_L7"),
        (2, 2, "request.args.get", "flask_request", "load"), (2, 6, "request.form['name']", "flask_request", "execute"),
    }


def test_sinks(spark):
    found = {(r.k, r.line, r.callee, r.sink_type, r.uses_template) for r in taint.sinks(lines(spark), "k").collect()}
    assert found == {
        (1, 4, "query", "sql_query", True), (1, 5, "send", "response_write", False), (1, 7, "get", "url_fetch", False), (1, 8, "exec", "command_exec", False),
        (2, 3, "cursor.execute", "sql_query", True), (2, 6, "open", "file_read", False),
    }


def test_flows(spark):
    code = lines(spark)
    rows = taint.flows(taint.sources(code, "k"), taint.sinks(code, "k"), "k").collect()
    found = {(r.k, r.source_line, r.sink_line): (round(r.score, 6), sorted(r.factors)) for r in rows}
    assert found[(1, 2, 4)] == (0.94, ["base", "near", "same_file", "same_function", "template"])
    assert found[(1, 2, 8)] == (0.8, ["base", "near", "same_file"])
    assert found[(2, 6, 6)] == (0.94, ["base", "near", "same_file", "same_function"]) and (2, 6, 3) in found
    empty = code.limit(0)
    assert taint.flows(taint.sources(empty, "k"), taint.sinks(empty, "k"), "k").count() == 0


def test_candidates(spark):
    rows = [("get_user_input", ["flask", "os"], 1.0), ("escape_html", None, None), ("plain", ["flask"], 1.0)]
    df = spark.createDataFrame(rows, "name string, imports array<string>, rank double")
    found = {(r.name, r.kind): round(r.score, 6) for r in taint.candidates(df, "name", "imports", "rank").collect()}
    assert found == {("get_user_input", "source"): 0.79, ("escape_html", "sanitizer"): 0.45}


def test_fixed_tables_are_complete():
    assert len(scalars.LANGUAGES) == 37 and len(scalars.WEAKNESSES) == 20
    assert {k: len(v) for k, v in taint.SINKS.items()} == {"javascript": 27, "typescript": 18, "python": 15, "java": 12, "php": 14, "go": 9, "kotlin": 6, "c": 9, "cpp": 4}
    assert {k: len(v) for k, v in taint.NAMES.items()} == {"source": 36, "sink": 48, "sanitizer": 23} and {k: len(v.split()) for k, v in taint.IMPORTS.items()} == {"source": 23, "sink": 29, "sanitizer": 16}
