"""Sources and sinks of untrusted data in code, the flows between them, and candidates among functions.

Code is read line by line with built-in expressions: member expressions are matched with source patterns, callees with sink
patterns, and each line knows the function it stands in. Of several patterns the first of its table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeflow.operators.flows import pair_flows

# Patterns of sources (pattern, type, weaknesses) by language, in the order they are tried.
_JS_SOURCES = (
    ("req.body", "request_body", "CWE-89 CWE-78 CWE-79 CWE-22"),
    ("req.params", "request_params", "CWE-89 CWE-78 CWE-22"),
    ("req.query", "request_query", "CWE-89 CWE-78 CWE-918 CWE-22"),
    ("req.headers", "request_headers", "CWE-79"),
    ("req.cookies", "request_cookies", "CWE-79"),
    ("process.env", "environment", "CWE-78"),
)
SOURCES = {
    "javascript": _JS_SOURCES,
    "typescript": _JS_SOURCES,
    "python": (
        ("request.form", "flask_request", "CWE-89 CWE-78 CWE-79 CWE-22"),
        ("request.args", "flask_request", "CWE-89 CWE-78 CWE-918 CWE-22"),
        ("request.json", "flask_request", "CWE-89 CWE-78 CWE-22"),
        ("request.GET", "django_request", "CWE-89 CWE-78 CWE-918 CWE-22"),
        ("request.POST", "django_request", "CWE-89 CWE-78 CWE-79 CWE-22"),
        ("os.environ", "environment", "CWE-78"),
        ("sys.argv", "user_input", "CWE-78 CWE-22"),
    ),
    "java": (
        ("request.getParameter", "servlet_param", "CWE-89 CWE-78 CWE-79 CWE-22"),
        ("request.getHeader", "request_headers", "CWE-79"),
        ("@RequestParam", "spring_param", "CWE-89 CWE-78 CWE-22"),
        ("@PathVariable", "spring_param", "CWE-89 CWE-22"),
        ("System.getenv", "environment", "CWE-78"),
    ),
    "php": (
        ("$_GET", "php_superglobal", "CWE-89 CWE-78 CWE-918 CWE-22"),
        ("$_POST", "php_superglobal", "CWE-89 CWE-78 CWE-79 CWE-22"),
        ("$_REQUEST", "php_superglobal", "CWE-89 CWE-78 CWE-79 CWE-22"),
        ("$_COOKIE", "php_superglobal", "CWE-79"),
        ("$_SERVER", "php_superglobal", "CWE-79"),
        ("getenv", "environment", "CWE-78"),
    ),
    "go": (
        ("r.URL.Query", "go_request", "CWE-89 CWE-78 CWE-918 CWE-22"),
        ("r.FormValue", "go_request", "CWE-89 CWE-78 CWE-79 CWE-22"),
        ("r.PostFormValue", "go_request", "CWE-89 CWE-78 CWE-22"),
        ("r.Header.Get", "request_headers", "CWE-79"),
        ("os.Getenv", "environment", "CWE-78"),
    ),
}
# Patterns of sinks (pattern, type, weaknesses) by language, in the order they are tried.
SINKS = {
    "javascript": (
        ("exec", "command_exec", "CWE-78"), ("execSync", "command_exec", "CWE-78"), ("spawn", "command_exec", "CWE-78"), ("spawnSync", "command_exec", "CWE-78"),
        ("query", "sql_query", "CWE-89"), ("execute", "sql_query", "CWE-89"), ("raw", "sql_query", "CWE-89"),
        ("eval", "code_exec", "CWE-94"), ("Function", "code_exec", "CWE-94"),
        ("innerHTML", "dom_write", "CWE-79"), ("outerHTML", "dom_write", "CWE-79"), ("document.write", "dom_write", "CWE-79"), ("insertAdjacentHTML", "dom_write", "CWE-79"),
        ("send", "response_write", "CWE-79"), ("render", "template_render", "CWE-79"),
        ("readFileSync", "file_read", "CWE-22"), ("readFile", "file_read", "CWE-22"), ("writeFileSync", "file_write", "CWE-22"), ("writeFile", "file_write", "CWE-22"),
        ("readdirSync", "file_read", "CWE-22"), ("readdir", "file_read", "CWE-22"), ("download", "file_read", "CWE-22"),
        ("fetch", "url_fetch", "CWE-918"), ("axios", "url_fetch", "CWE-918"), ("get", "url_fetch", "CWE-918"), ("post", "url_fetch", "CWE-918"),
        ("redirect", "redirect", "CWE-601"),
    ),
    "typescript": (
        ("exec", "command_exec", "CWE-78"), ("execSync", "command_exec", "CWE-78"), ("spawn", "command_exec", "CWE-78"),
        ("query", "sql_query", "CWE-89"), ("execute", "sql_query", "CWE-89"),
        ("eval", "code_exec", "CWE-94"), ("Function", "code_exec", "CWE-94"),
        ("innerHTML", "dom_write", "CWE-79"), ("insertAdjacentHTML", "dom_write", "CWE-79"), ("bypassSecurityTrustHtml", "dom_write", "CWE-79"),
        ("bypassSecurityTrustScript", "code_exec", "CWE-94"), ("bypassSecurityTrustUrl", "redirect", "CWE-601"), ("bypassSecurityTrustResourceUrl", "url_fetch", "CWE-918"),
        ("readFileSync", "file_read", "CWE-22"), ("writeFileSync", "file_write", "CWE-22"),
        ("fetch", "url_fetch", "CWE-918"), ("get", "url_fetch", "CWE-918"), ("post", "url_fetch", "CWE-918"),
    ),
    "python": (
        ("execute", "sql_query", "CWE-89"), ("executemany", "sql_query", "CWE-89"), ("raw", "sql_query", "CWE-89"),
        ("os.system", "command_exec", "CWE-78"), ("subprocess.run", "command_exec", "CWE-78"), ("subprocess.call", "command_exec", "CWE-78"), ("subprocess.Popen", "command_exec", "CWE-78"),
        ("eval", "code_exec", "CWE-94"), ("exec", "code_exec", "CWE-94"), ("open", "file_read", "CWE-22"),
        ("requests.get", "url_fetch", "CWE-918"), ("requests.post", "url_fetch", "CWE-918"), ("urllib.request.urlopen", "url_fetch", "CWE-918"),
        ("pickle.loads", "deserialize", "CWE-502"), ("yaml.load", "deserialize", "CWE-502"),
    ),
    "java": (
        ("executeQuery", "sql_query", "CWE-89"), ("executeUpdate", "sql_query", "CWE-89"), ("execute", "sql_query", "CWE-89"),
        ("Runtime.exec", "command_exec", "CWE-78"), ("ProcessBuilder", "command_exec", "CWE-78"), ("ScriptEngine.eval", "code_exec", "CWE-94"),
        ("FileInputStream", "file_read", "CWE-22"), ("FileOutputStream", "file_write", "CWE-22"), ("URL.openConnection", "url_fetch", "CWE-918"), ("HttpURLConnection", "url_fetch", "CWE-918"),
        ("ObjectInputStream.readObject", "deserialize", "CWE-502"), ("response.sendRedirect", "redirect", "CWE-601"),
    ),
    "php": (
        ("mysqli_query", "sql_query", "CWE-89"), ("mysql_query", "sql_query", "CWE-89"), ("pg_query", "sql_query", "CWE-89"),
        ("exec", "command_exec", "CWE-78"), ("system", "command_exec", "CWE-78"), ("passthru", "command_exec", "CWE-78"), ("shell_exec", "command_exec", "CWE-78"),
        ("eval", "code_exec", "CWE-94"), ("include", "file_read", "CWE-22 CWE-98"), ("require", "file_read", "CWE-22 CWE-98"),
        ("file_get_contents", "file_read", "CWE-22 CWE-918"), ("file_put_contents", "file_write", "CWE-22"), ("unserialize", "deserialize", "CWE-502"), ("header", "redirect", "CWE-601"),
    ),
    "go": (
        ("db.Query", "sql_query", "CWE-89"), ("db.Exec", "sql_query", "CWE-89"), ("exec.Command", "command_exec", "CWE-78"), ("os.Open", "file_read", "CWE-22"), ("os.Create", "file_write", "CWE-22"),
        ("ioutil.ReadFile", "file_read", "CWE-22"), ("http.Get", "url_fetch", "CWE-918"), ("http.Post", "url_fetch", "CWE-918"), ("http.Redirect", "redirect", "CWE-601"),
    ),
    "kotlin": (
        ("executeQuery", "sql_query", "CWE-89"), ("execute", "sql_query", "CWE-89"), ("Runtime.getRuntime().exec", "command_exec", "CWE-78"), ("ProcessBuilder", "command_exec", "CWE-78"),
        ("File", "file_read", "CWE-22"), ("URL", "url_fetch", "CWE-918"),
    ),
    "c": (
        ("system", "command_exec", "CWE-78"), ("popen", "command_exec", "CWE-78"), ("execve", "command_exec", "CWE-78"), ("execl", "command_exec", "CWE-78"), ("fopen", "file_read", "CWE-22"),
        ("sprintf", "dangerous_call", "CWE-120"), ("strcpy", "dangerous_call", "CWE-120"), ("strcat", "dangerous_call", "CWE-120"), ("gets", "dangerous_call", "CWE-120"),
    ),
    "cpp": (("system", "command_exec", "CWE-78"), ("popen", "command_exec", "CWE-78"), ("std::ifstream", "file_read", "CWE-22"), ("std::ofstream", "file_write", "CWE-22")),
}
# Telling names of functions with their scores, and telling imports.
NAMES = {
    "source": (
        ("get_.*input", 0.9), ("read_.*request", 0.9), ("fetch_.*param", 0.8), ("get_.*param", 0.8), (r"request\.", 0.7), ("get_.*user", 0.7), ("read_.*file", 0.6), ("read_.*data", 0.6),
        ("input", 0.5), ("getenv", 0.5), ("environ", 0.5), ("argv", 0.5), ("stdin", 0.5), ("fetch", 0.4), ("recv", 0.4), ("receive", 0.4),
        ("get.*request.*body", 0.9), ("read.*request.*body", 0.9), ("request.*body", 0.8), ("get.*body", 0.7), ("read.*body", 0.7), ("get.*params", 0.7), ("read.*params", 0.7), ("route.*params", 0.6),
        ("get.*query", 0.7), ("parse.*query", 0.7), ("query.*string", 0.6), ("get.*header", 0.7), ("read.*headers", 0.7), ("get.*cookie", 0.8), ("parse.*cookies", 0.8), ("read.*cookie", 0.7),
        ("route.*param", 0.6), ("activated.*route", 0.5), ("get.*data", 0.4), ("fetch.*data", 0.4),
    ),
    "sink": (
        ("execute.*query", 0.95), ("exec.*sql", 0.95), ("run.*sql", 0.9), ("execute", 0.7), ("query", 0.6), ("raw.*query", 0.8), ("sequelize.*query", 0.8),
        ("system.*exec", 0.95), ("run.*command", 0.9), ("run.*cmd", 0.9), (r"os\.system", 0.95), ("popen", 0.9), ("subprocess", 0.8),
        ("^exec$", 0.8), ("execsync", 0.85), ("^spawn$", 0.75), ("spawnsync", 0.8), ("execfile", 0.8), ("child.*process", 0.7),
        ("innerhtml", 0.9), ("outerhtml", 0.8), ("dangerously.*html", 0.95), ("dangerouslysetinnerhtml", 0.95),
        ("bypasssecuritytrust", 0.95), ("bypasssecuritytrusthtml", 0.95), ("bypasssecuritytrustscript", 0.95), ("bypasssecuritytruststyle", 0.9), ("bypasssecuritytrusturl", 0.9), ("bypasssecuritytrustresourceurl", 0.9),
        ("^eval$", 0.9), ("new.*function", 0.85), ("settimeout.*string", 0.8), ("setinterval.*string", 0.8),
        ("readfile", 0.7), ("readfilesync", 0.75), ("writefile", 0.7), ("writefilesync", 0.75), ("unlinksync", 0.7), ("write.*file", 0.6), ("open", 0.4),
        ("render", 0.5), ("render.*template", 0.5), ("download", 0.5), ("sendfile", 0.6), ("send.*file", 0.5), ("fetch.*url", 0.6), ("request.*url", 0.6), ("http.*get", 0.5),
    ),
    "sanitizer": (
        ("sanitize", 0.95), ("escape", 0.9), ("clean", 0.7), ("validate", 0.8), ("filter", 0.5), ("encode", 0.6), ("normalize", 0.5), ("strip", 0.4), ("check", 0.3), ("verify", 0.4), ("safe", 0.5), ("whitelist", 0.7),
        ("escape.*html", 0.9), ("sanitize.*html", 0.95), ("purify", 0.8), ("dompurify", 0.9), ("isvalid", 0.5), ("is.*valid", 0.4), ("validate.*input", 0.9), ("express.*validator", 0.85), ("xss.*filter", 0.9),
        ("parameterize", 0.8), ("prepared.*statement", 0.85),
    ),
}
IMPORTS = {
    "source": "flask django request fastapi tornado bottle aiohttp sys.argv argparse click os.environ dotenv express koa hapi restify fastify body-parser cookie-parser @angular/router activatedroute querystring url",
    "sink": "sqlite3 mysql psycopg pymongo sqlalchemy peewee subprocess os.system shlex eval exec jinja2 mako template sequelize mysql2 pg mongodb mongoose child_process shelljs fs path ejs pug handlebars mustache @angular/platform-browser domsanitizer",
    "sanitizer": "html.escape markupsafe bleach validators cerberus pydantic re regex dompurify sanitize-html xss validator express-validator joi escape-html he",
}
WEIGHTS = {"pattern": 0.5, "import": 0.2, "rank": 0.3}

MEMBER = r"[A-Za-z_$@][\w$]*(?:\.[\w$]+|\[[^\]]*\])+"
CALL = r"[\w$.]+\s*\("
DEFINITION = r"(?:\bdef|\bfunction)\s+[\w$]+\s*\("
FUNCTION = r"(?:\bdef\s+|\bfunction\s*\*?\s*)([A-Za-z_$][\w$]*)\s*\(|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"
ANONYMOUS = r"\([^()]*\)\s*=>"
#: How sure a match is, and of how many characters of a sink its text is kept.
CONFIDENCE, SHOWN = 0.85, 200


def _first(language: Column, patterns: dict, test) -> Column:
    """The first pattern of the language that holds, as (pattern, kind, cwes); null if none does."""
    rows = {name: F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(kind).alias("kind"), F.split(F.lit(cwes), " ").alias("cwes")) for p, kind, cwes in own)) for name, own in patterns.items()}
    table = F.create_map(*(x for name, own in rows.items() for x in (F.lit(name), own)))
    return F.get(F.filter(table[language], lambda p: test(p["pattern"])), 0)


def code_lines(df: DataFrame, key: str, code: str, language: str) -> DataFrame:
    """key, line (from 1), text, language, function: each line with the function it stands in, null before the first.

    A function without a name is called by its line. Null code has no lines.
    """
    rows = df.where(F.col(code).isNotNull()).select(key, F.col(language).alias("language"), F.posexplode(F.split(code, "\n")).alias("at", "text"))
    named = F.nullif(F.coalesce(F.nullif(F.regexp_extract("text", FUNCTION, 1), F.lit("")), F.regexp_extract("text", FUNCTION, 2)), F.lit(""))
    anonymous = F.when(F.col("text").rlike(ANONYMOUS), F.concat(F.lit("__anonymous_handler_L"), F.col("at") + 1))
    marked = rows.withColumn("own", F.coalesce(named, anonymous))
    inside = F.last("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))  # the lines of one text
    return marked.select(key, (F.col("at") + 1).alias("line"), "text", "language", inside.alias("function"))


def sources(lines: DataFrame, key: str) -> DataFrame:
    """key, line, function, expression, source_type, cwes, confidence: member expressions that bring in untrusted data, outermost ones, one row per line and text."""
    found = lines.select(key, "line", "function", "language", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MEMBER), F.lit(0)))).alias("expression"))
    scripts = F.col("language").isin("javascript", "typescript")
    held = lambda p: F.when(scripts, F.startswith("expression", p)).otherwise(F.contains("expression", p))
    typed = found.withColumn("m", _first(F.col("language"), SOURCES, held)).where("m is not null")
    return typed.select(key, "line", "function", "expression", F.col("m.kind").alias("source_type"), "m.cwes", F.lit(CONFIDENCE).alias("confidence"))


def sinks(lines: DataFrame, key: str) -> DataFrame:
    """key, line, function, callee, expression, sink_type, cwes, uses_template, confidence: calls that do harm with untrusted data.

    A callee matches a pattern that it ends with; of scripts and Go only its last name counts. The expression is the line from
    the call on, SHOWN characters of it.
    """
    calls = F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", DEFINITION, "("), F.lit(CALL), F.lit(0)))
    found = lines.select(key, "line", "function", "language", "text", F.explode(calls).alias("call"))
    chain = F.regexp_replace("call", r"\s*\($", "")
    callee = F.when(F.col("language").isin("javascript", "typescript", "go", "java"), F.regexp_replace(chain, r"^.*\.", "")).otherwise(chain)
    rest = F.expr("substring(text, greatest(locate(call, text), 1))")
    python = F.contains(rest, F.lit('f"')) | F.contains(rest, F.lit("f'"))
    template = F.when(F.col("language") == "python", python).otherwise(F.col("language").isin("javascript", "typescript") & F.contains(rest, F.lit("`")))
    rows = found.select(key, "line", "function", "language", callee.alias("callee"), F.substring(rest, 1, SHOWN).alias("expression"), template.alias("uses_template"))
    typed = rows.withColumn("m", _first(F.col("language"), SINKS, lambda p: F.endswith("callee", p))).where("m is not null")
    return typed.select(key, "line", "function", "callee", "expression", F.col("m.kind").alias("sink_type"), "m.cwes", "uses_template", F.lit(CONFIDENCE).alias("confidence"))


def flows(found_sources: DataFrame, found_sinks: DataFrame, key: str) -> DataFrame:
    """Sources and sinks of one file that share a weakness, once per pair of places.

    Adds ``same_function`` (false where either stands in none), ``score`` and ``factors`` (what adds up to it). Repeated places count once.
    """
    s = found_sources.dropDuplicates([key, "line", "expression"])
    k = found_sinks.dropDuplicates([key, "line", "callee", "expression"])
    pairs = pair_flows(s.drop("confidence"), k.drop("confidence"), [key], "cwes", "line")
    same = F.coalesce(F.col("source_function") == F.col("sink_function"), F.lit(False))
    parts = {"base": F.lit(0.5), "same_function": F.when(same, 0.3).otherwise(0.0), "template": F.when(F.col("sink_uses_template"), 0.4).otherwise(0.0)}
    near = F.when(F.col("distance") < 10, 0.2).when(F.col("distance") < 20, 0.1).otherwise(0.0)
    parts |= {"near": near, "same_file": F.lit(0.1)}
    total = parts["base"] + parts["same_function"] + parts["template"] + parts["near"] + parts["same_file"]
    factors = F.map_filter(F.create_map(*(x for name, v in parts.items() for x in (F.lit(name), v))), lambda _, v: v > 0)
    return pairs.withColumn("same_function", same).withColumn("factors", factors).withColumn("score", F.least(total, F.lit(0.94)))


def candidates(functions: DataFrame, name: str, imports: str, rank: str) -> DataFrame:
    """The rows for each kind (source, sink, sanitizer) that the name tells: adds ``kind`` and ``score``.

    The score weighs the best pattern of the name, the telling imports (0.2 each, 0.5 at most) and the rank of the file; a name that no
    pattern matches is no candidate.
    """
    low, joined = F.lower(F.col(name)), F.lower(F.array_join(F.coalesce(F.col(imports), F.array().cast("array<string>")), " "))
    kinds = []
    for kind, patterns in NAMES.items():
        best = F.greatest(F.lit(0.0), *(F.when(low.rlike(p), F.lit(s)).otherwise(0.0) for p, s in patterns))
        told = F.least(F.lit(0.5), sum((F.contains(joined, F.lit(w)).cast("int") for w in IMPORTS[kind].split()), F.lit(0)) * F.lit(0.2))
        kinds.append(F.struct(F.lit(kind).alias("kind"), best.alias("best"), told.alias("told")))
    out = functions.select("*", F.explode(F.array(*kinds)).alias("_k")).where("_k.best > 0")
    score = WEIGHTS["pattern"] * F.col("_k.best") + WEIGHTS["import"] * F.col("_k.told") + WEIGHTS["rank"] * F.coalesce(F.col(rank), F.lit(0.0))
    return out.withColumn("kind", F.col("_k.kind")).withColumn("score", score).drop("_k")
