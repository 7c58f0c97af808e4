"""Extraction over source files, and what follows from it, each query with its SQL.

The test tables hold no source code. So every row of `part` gives one file of each language: a fixture in whose text and
path a name is made the row's own. What a fixture must give is written out in EXPECTED; the SQL makes the rows of all files
from it.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import chunking, corpus, extract, graph, stats

FIXTURES = {
    "src/shape.rs": '/// A flat shape.\n#[derive(Debug, Clone)]\npub struct Shape {\n    pub name: String,\n    sides: u32,\n}\n\npub trait Area: Named + Sized {\n    type Unit;\n    fn area(&self) -> f64;\n    fn double(&self) -> f64 {\n        self.area() * 2.0\n    }\n}\n\nimpl Area for Shape {\n    type Unit = f64;\n    fn area(&self) -> f64 {\n        if self.sides > 3 {\n            measure(self.sides)\n        } else {\n            Square::new(1).area()\n        }\n    }\n}\n\npub enum Kind {\n    Flat,\n    Solid { depth: u8 },\n    Pair(u8, u8),\n}\n\npub const LIMIT: u32 = 7;\n\npub async fn load(path: &str, mut depth: u32) -> Result<Shape, Error> {\n    for p in walk(path) {\n        push(p);\n    }\n    Shape::default()\n}\n',
    "src/queue.ts": "export enum Level { Low, High = 3 }\n\nexport interface Sink {\n  write(line: string): void;\n  close(): void;\n}\n\nexport class Queue extends Base implements Sink {\n  private items: string[] = [];\n  protected limit: number;\n\n  async write(line: string): Promise<void> {\n    if (line) {\n      this.items.push(line);\n    }\n    const log = new Logger('q');\n    flush(log);\n  }\n}\n\nfunction flush(log) {\n  while (log.next()) { emit(log); }\n}\n",
    "pkg/__init__.py": 'import os\n\n\nclass Store(Base):\n    """Keeps rows."""\n\n    def __init__(self, path):\n        self.path = path\n        self.rows = []\n\n    async def load(self, limit: int = 3) -> list:\n        """Reads rows."""\n        for row in read(self.path):\n            if row:\n                self.rows.append(Row(row))\n        return self.rows\n\n\ndef _hidden(a, *rest):\n    return os.path.join(a)\n',
    "cmd/main.go": "package main\n\n// Server answers requests.\ntype Server struct {\n\tAddr, name string\n\tport int\n}\n\ntype Handler interface {\n\tServe(path string) error\n}\n\n// Start runs it.\nfunc (s *Server) Start(port int, opts *Options) error {\n\tfor _, o := range list(opts) {\n\t\to.Apply(s)\n\t}\n\treturn Listen(port)\n}\n\nfunc helper() {}\n",
    "app/Account.java": "package app;\n\n/** An account. */\npublic class Account extends Base implements Owned {\n    private final String owner;\n    protected int cents, limit = 5;\n\n    /** Pays in. */\n    public synchronized void pay(final int amount, String note) {\n        if (amount > 0) {\n            audit(note);\n        }\n        Ledger book = new Ledger(owner);\n        book.post(amount);\n    }\n\n    enum State { OPEN, CLOSED }\n}\n\ninterface Owned {\n    String owner();\n}\n",
    "app/Order.cs": "namespace App;\n\n/// <summary>An order.</summary>\npublic class Order : Entity, IPriced\n{\n    private decimal total;\n    public string Name { get; set; }\n\n    public async Task Send(ref int tries, string to)\n    {\n        foreach (var line in Lines())\n        {\n            mailer.Post(line);\n        }\n        var box = new Parcel(to);\n    }\n}\n\ninternal interface IPriced { decimal Price(); }\n\npublic enum Status { New, Paid }\n",
    "src/broken.rs": "pub struct Half {\n    x: u8,\n\npub async fn still_found(x: u8) {\n    step(x);\n",
    "src/View.kt": "class View {\n    fun draw() {\n        paint(1)\n    }\n}\n",
    "README.md": "# Notes\n\nCall run() first.\n",
    "empty.py": "",
    "src/global.rs": '/// Calls so far.\npub static mut COUNT: u32 = 0;\nstatic NAME: &str = "x";\n',
}


#: Of each fixture: the name that becomes a row's own; and its rows in order, nodes (kind, id, name, qualified name, first and last
#: line, visibility, whether async, parent, return type, signature, comment, branches, lines, bases, members, fields, attributes)
#: and edges (type, from, to, and of calls their type, whether conditional, whether in a loop).
EXPECTED = {
    "src/shape.rs": ("Shape", """
struct|struct:{path}:{name}|{name}|{name}|3|6|public|||||A flat shape.|1|4|Debug; Clone||name; sides|derive(Debug, Clone)
edge|contains|file:{path}|struct:{path}:{name}|||
trait|trait:{path}:Area|Area|Area|8|14|public||||||1|7|Named; Sized|area||double; type Unit
edge|contains|file:{path}|trait:{path}:Area|||
edge|extends|trait:{path}:Area|trait:?:Named|||
edge|extends|trait:{path}:Area|trait:?:Sized|||
impl|impl:{path}:Area_for_{name}|Area_for_{name}|{name}|16|25|private||Area|{name}|||4|10||area||
edge|contains|file:{path}|impl:{path}:Area_for_{name}|||
edge|implements|impl:{path}:Area_for_{name}|trait:?:Area|||
function|function:{path}:{name}::area|area|{name}::area|18|24|private|n|{name}|f64|fn area(&self) -> f64||3|7||||
edge|contains|impl:{path}:Area_for_{name}|function:{path}:{name}::area|||
edge|calls|function:{path}:{name}::area|function:?:measure|direct|y|n
edge|calls|function:{path}:{name}::area|function:?:area|method|y|n
enum|enum:{path}:Kind|Kind|Kind|27|31|public||||||1|5||Flat; Solid; Pair||
edge|contains|file:{path}|enum:{path}:Kind|||
const|const:{path}:LIMIT|LIMIT|LIMIT|33|33|public|||u32||||||||
edge|contains|file:{path}|const:{path}:LIMIT|||
function|function:{path}:load|load|load|35|40|public|y||Result<{name}, Error>|pub async fn load(path: &str, mut depth: u32) -> Result<{name}, Error>||2|6||||
edge|contains|file:{path}|function:{path}:load|||
edge|returns_type|function:{path}:load|type:?:Result<{name}, Error>|||
edge|calls|function:{path}:load|function:?:walk|direct|n|y
edge|calls|function:{path}:load|function:?:push|direct|n|y
edge|calls|function:{path}:load|function:?:default|direct|n|n
"""),
    "src/queue.ts": ("Queue", """
enum|enum:{path}:Level|Level|Level|1|1|public||||||1|1||Low; High||
edge|contains|file:{path}|enum:{path}:Level|||
trait|trait:{path}:Sink|Sink|Sink|3|6|public||||||1|4||write; close||
edge|contains|file:{path}|trait:{path}:Sink|||
struct|struct:{path}:{name}|{name}|{name}|8|19|public||||||2|12|Base; Sink||items; limit|
edge|contains|file:{path}|struct:{path}:{name}|||
function|function:{path}:write|write|write|12|18|private|y|{name}|Promise<void>|async write(line: string): Promise<void>||2|7||||
edge|contains|file:{path}|function:{path}:write|||
edge|calls|function:{path}:write|function:?:push|method|y|n
edge|calls|function:{path}:write|function:?:Logger|constructor|n|n
edge|calls|function:{path}:write|function:?:flush|direct|n|n
function|function:{path}:flush|flush|flush|21|23|private|n|||function flush(log)||2|3||||
edge|contains|file:{path}|function:{path}:flush|||
edge|calls|function:{path}:flush|function:?:next|method|n|y
edge|calls|function:{path}:flush|function:?:emit|direct|n|y
"""),
    "pkg/__init__.py": ("Store", """
struct|struct:{path}:{name}|{name}|{name}|4|16|public|||||Keeps rows.|3|13|Base||path; rows|
edge|contains|file:{path}|struct:{path}:{name}|||
function|function:{path}:__init__|__init__|__init__|7|9|public_crate|n|{name}||def __init__(self, path)||1|3||||
edge|contains|file:{path}|function:{path}:__init__|||
function|function:{path}:load|load|load|11|16|public|y|{name}|list|async def load(self, limit: int = 3) -> list|Reads rows.|3|6||||
edge|contains|file:{path}|function:{path}:load|||
edge|calls|function:{path}:load|function:?:read|direct|n|y
edge|calls|function:{path}:load|function:?:append|method|y|y
edge|calls|function:{path}:load|function:?:Row|constructor|y|y
function|function:{path}:_hidden|_hidden|_hidden|19|20|public_crate|n|||def _hidden(a, *rest)||1|2||||
edge|contains|file:{path}|function:{path}:_hidden|||
edge|calls|function:{path}:_hidden|function:?:join|method|n|n
"""),
    "cmd/main.go": ("Server", """
struct|struct:{path}:{name}|{name}|{name}|4|7|public|||||{name} answers requests.|1|4|||Addr; name; port|
edge|contains|file:{path}|struct:{path}:{name}|||
trait|trait:{path}:Handler|Handler|Handler|9|11|public||||||1|3||Serve||
edge|contains|file:{path}|trait:{path}:Handler|||
function|function:{path}:{name}.Start|Start|{name}.Start|14|19|public|n|{name}|error|func (s *{name}) Start(port int, opts *Options) error|Start runs it.|2|6||||
edge|contains|file:{path}|function:{path}:{name}.Start|||
edge|calls|function:{path}:{name}.Start|function:?:list|direct|n|y
edge|calls|function:{path}:{name}.Start|function:?:Apply|method|n|y
edge|calls|function:{path}:{name}.Start|function:?:Listen|constructor|n|n
function|function:{path}:helper|helper|helper|21|21|private|n|||func helper()||1|1||||
edge|contains|file:{path}|function:{path}:helper|||
"""),
    "app/Account.java": ("Account", """
struct|struct:{path}:{name}|{name}|{name}|4|18|public|||||An account.|2|15|Base; Owned||owner; cents; limit|public
edge|contains|file:{path}|struct:{path}:{name}|||
function|function:{path}:{name}.pay|pay|{name}.pay|9|15|public|y|{name}|void|public synchronized void pay(final int amount, String note)|Pays in.|2|7||||public; synchronized
edge|contains|file:{path}|function:{path}:{name}.pay|||
edge|calls|function:{path}:{name}.pay|function:?:audit|method|y|n
edge|calls|function:{path}:{name}.pay|function:?:Ledger|constructor|n|n
edge|calls|function:{path}:{name}.pay|function:?:post|method|n|n
enum|enum:{path}:State|State|State|17|17|public_crate||||||1|1||OPEN; CLOSED||
edge|contains|file:{path}|enum:{path}:State|||
trait|trait:{path}:Owned|Owned|Owned|20|22|public_crate||||||1|3||owner||
edge|contains|file:{path}|trait:{path}:Owned|||
function|function:{path}:owner|owner|owner|21|21|public_crate|n||String|String owner()||1|1||||
edge|contains|file:{path}|function:{path}:owner|||
"""),
    "app/Order.cs": ("Order", """
struct|struct:{path}:{name}|{name}|{name}|4|17|public|||||An order.|2|14|Entity; IPriced||total; Name|public
edge|contains|file:{path}|struct:{path}:{name}|||
function|function:{path}:{name}.Send|Send|{name}.Send|9|16|public|y|{name}|Task|public async Task Send(ref int tries, string to)||2|8||||public; async
edge|contains|file:{path}|function:{path}:{name}.Send|||
edge|calls|function:{path}:{name}.Send|function:?:Lines|method|n|y
edge|calls|function:{path}:{name}.Send|function:?:Post|method|n|y
edge|calls|function:{path}:{name}.Send|function:?:Parcel|constructor|n|n
trait|trait:{path}:IPriced|IPriced|IPriced|19|19|public_crate||||||1|1||Price||internal
edge|contains|file:{path}|trait:{path}:IPriced|||
function|function:{path}:Price|Price|Price|19|19|private|n||decimal|decimal Price()||1|1||||
edge|contains|file:{path}|function:{path}:Price|||
enum|enum:{path}:Status|Status|Status|21|21|public||||||1|1||New; Paid||public
edge|contains|file:{path}|enum:{path}:Status|||
"""),
    "src/View.kt": ("View", """
struct|struct:{path}:{name}|{name}|{name}|1|5|private|||||||||||
edge|contains|file:{path}|struct:{path}:{name}|||
function|function:{path}:draw|draw|draw|2|4|private|n||||||||||
edge|contains|file:{path}|function:{path}:draw|||
edge|calls|function:{path}:draw|function:?:draw|direct|n|n
edge|calls|function:{path}:draw|function:?:paint|direct|n|n
"""),
    "src/global.rs": ("COUNT", """
static|static:{path}:{name}|{name}|{name}|2|2|public|||u32||Calls so far.||||||
edge|contains|file:{path}|static:{path}:{name}|||
static|static:{path}:NAME|NAME|NAME|3|3|private|||&str||||||||
edge|contains|file:{path}|static:{path}:NAME|||
"""),
    "src/broken.rs": ("Half", """
struct|struct:{path}:{name}|{name}|{name}|1|5|public|||||||||||
edge|contains|file:{path}|struct:{path}:{name}|||
function|function:{path}:still_found|still_found|still_found|3|5|public|y||||||||||
edge|contains|file:{path}|function:{path}:still_found|||
edge|calls|function:{path}:still_found|function:?:still_found|direct|n|n
edge|calls|function:{path}:still_found|function:?:step|direct|n|n
"""),
}
NODE = ("kind", "id", "name", "qualified_name", "start_line", "end_line", "visibility", "is_async", "parent", "return_type", "signature", "doc_comment", "cyclomatic", "loc", "bases", "members", "fields", "attributes")
EDGE = ("kind", "edge_type", "src", "dst", "call_type", "is_conditional", "is_in_loop")
NUMBERS, FLAGS, LISTS = ("start_line", "end_line", "cyclomatic", "loc"), ("is_async", "is_conditional", "is_in_loop"), ("bases", "members", "fields", "attributes")
COLUMNS = (*NODE, *EDGE[1:])


def fixtures(spark: SparkSession, *suffixes: str) -> DataFrame:
    rows = [(k, v) for k, v in FIXTURES.items() if not suffixes or k.endswith(suffixes)]
    return spark.createDataFrame(rows, "path string, content string")


def sources(spark: SparkSession, sf: str, *suffixes: str) -> DataFrame:
    """path, content: a file of each fixture for every row of part."""
    kinds = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(word).alias("word"), F.lit(FIXTURES[p]).alias("content")) for p, (word, _) in EXPECTED.items() if not suffixes or p.endswith(suffixes)])
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("k"))
    # a few bytes a row become files to parse: they are dealt out before that
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = parts.repartition(tasks).select("k", F.explode(kinds).alias("f"))
    return rows.select(F.concat("k", F.lit("/"), "f.path").alias("path"), F.replace("f.content", F.col("f.word"), F.concat("f.word", "k")).alias("content"))


def found(spark: SparkSession, sf: str, *suffixes: str, columns: Sequence[str] = ("file_path", "ordinal", *COLUMNS), wanted: Collection[str] | None = None, firsts: bool = False) -> DataFrame:
    """The extracted rows of all sources, lists as text; only columns, and only what is wanted."""
    rows = extract.extracted(sources(spark, sf, *suffixes), [*columns, *({"edge_type"} - set(columns))], wanted, firsts)
    text = lambda c: F.array_join("fields.name" if c == "fields" else c, "; ")
    node = F.col("edge_type").isNull()
    return rows.select(*[F.when(node, F.coalesce(text(c), F.lit(""))).alias(c) if c in LISTS else F.col(c) for c in columns])


def _literal(column: str, value: str) -> str:
    if column in LISTS:
        return f"'{value}'"
    if not value:
        return "NULL"
    return value if column in NUMBERS else str(value == "y") if column in FLAGS else f"'{value}'"


def _found_sql(*suffixes: str) -> str:
    """The common table `found`: what `found` must give."""
    rows = []
    for path, (word, text) in EXPECTED.items():
        for n, line in enumerate(text.strip().split("\n")):
            if not suffixes or path.endswith(suffixes):
                parts = line.split("|")
                values = dict(zip(EDGE if parts[0] == "edge" else NODE, parts))
                literals = [_literal(c, values[c]) if c in values else "NULL" for c in COLUMNS]
                rows.append(f"('{path}', '{word}', {n}, {', '.join(literals)})")
    whole = lambda c: f"replace(replace({c}, '{{path}}', k || '/' || path), '{{name}}', word || k) AS {c}"
    own = ", ".join(c if c in (*NUMBERS, *FLAGS) else whole(c) for c in COLUMNS)
    return f"k AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part), e(path, word, ordinal, {', '.join(COLUMNS)}) AS (VALUES {', '.join(rows)}), found AS (SELECT k || '/' || path AS file_path, ordinal, {own} FROM e, k)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _language(name: str, suffix: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return found(spark, sf, suffix)

    QUERIES[f"extract_{name}"], ORACLE_SQL[f"extract_{name}"] = run, f"WITH {_found_sql(suffix)} SELECT * FROM found"


for _name, _suffix in {"rust": ".rs", "typescript": ".ts", "python": ".py", "go": ".go", "java": ".java", "csharp": ".cs", "fallback": ".kt"}.items():
    _language(_name, _suffix)


# Whole rows of each kind of entity

LISTINGS = {
    "struct": ("list_structs", ("id", "name", "qualified_name", "file_path", "start_line", "end_line", "visibility", "doc_comment", "fields", "bases", "attributes")),
    "trait": ("list_traits", ("id", "name", "qualified_name", "file_path", "start_line", "end_line", "visibility", "doc_comment", "bases", "members")),
    "enum": ("list_enums", ("id", "name", "qualified_name", "file_path", "start_line", "end_line", "visibility", "doc_comment", "members", "attributes")),
    "impl": ("list_impls", ("id", "name", "file_path", "start_line", "end_line", "parent", "return_type", "members")),
    "const": ("list_constants", ("id", "name", "qualified_name", "file_path", "start_line", "visibility", "return_type")),
    "static": ("list_statics", ("id", "name", "qualified_name", "file_path", "start_line", "end_line", "visibility", "return_type", "doc_comment")),
    "function": ("list_function_entities", ("id", "name", "qualified_name", "file_path", "start_line", "end_line", "visibility", "doc_comment", "signature", "parent", "is_async", "return_type", "cyclomatic", "loc", "attributes")),
}


def _listing(kind: str, name: str, columns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = found(spark, sf, columns=dict.fromkeys((*columns, "file_path", "ordinal")), wanted=(kind,), firsts=True)
        return own.select(*columns)  # an id holds its file's path, so the first one of a file is the first of all

    QUERIES[name], ORACLE_SQL[name] = run, f"WITH {_found_sql()} SELECT {', '.join(columns)} FROM found WHERE kind = '{kind}'"


for _kind, (_name, _columns) in LISTINGS.items():
    _listing(_kind, _name, _columns)


@query(f"WITH {_found_sql()} SELECT src AS impl_id, dst AS trait_id FROM found WHERE edge_type = 'implements'")
def list_implements(spark, sf):
    return graph.implementations(found(spark, sf, columns=("edge_type", "src", "dst"), wanted=("implements",)))


@query(f"WITH {_found_sql()} SELECT src, dst FROM found WHERE edge_type = 'contains' AND src IN (SELECT 'file:' || CAST(p_partkey AS VARCHAR) || '/src/shape.rs' FROM part WHERE p_size <= 25)")
def contains_of_known_files(spark, sf):
    known = spark.read.parquet(f"{sf}/part.parquet").where("p_size <= 25").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/src/shape.rs")).alias("path"))
    return graph.contained(found(spark, sf, columns=("edge_type", "src", "dst"), wanted=("contains",)), known)


@query(f"WITH {_found_sql()}, f AS (SELECT name, min(id) AS id FROM found WHERE kind = 'function' GROUP BY name) SELECT src, f.id AS dst, call_type, is_conditional, is_in_loop FROM found JOIN f ON f.name = replace(dst, 'function:?:', '') WHERE edge_type = 'calls'")
def calls_of_known_functions(spark, sf):
    own = ("src", "dst", "call_type", "is_conditional", "is_in_loop")
    rows = found(spark, sf, columns=("kind", "id", "name", "edge_type", *own), wanted=("function", "calls"))
    return graph.known_calls(rows, rows.where("kind = 'function'")).select(*own)


@query(f"WITH {_found_sql()} SELECT file_path, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_nodes" for k in stats.NODE_KINDS) + ", " + ", ".join(f"count(*) FILTER (edge_type = '{k}') AS {k}_edges" for k in stats.EDGE_KINDS) + " FROM found GROUP BY file_path")
def kinds_by_file(spark, sf):
    return stats.kinds_by_file(found(spark, sf, columns=("file_path", "kind", "edge_type")))


@query(f"WITH {_found_sql()} SELECT count(*) FILTER (edge_type IS NULL) AS nodes, count(*) FILTER (edge_type IS NOT NULL) AS edges FROM found")
def graph_counts(spark, sf):
    return found(spark, sf, columns=("edge_type",)).agg(F.count_if(F.col("edge_type").isNull()).alias("nodes"), F.count_if(F.col("edge_type").isNotNull()).alias("edges"))


LANGUAGES = sorted({k: v for k, v in schemas.LANGUAGE_OF.items() if k in extract.PARSERS}.items())


@query("SELECT * FROM (VALUES " + ", ".join(f"('{language}', '{min(e for e, x in LANGUAGES if x == language)}')" for language in sorted({x for _, x in LANGUAGES})) + ") v(language, extension)")
def parsers_by_language(spark, _):
    return spark.createDataFrame(LANGUAGES, "extension string, language string").groupBy("language").agg(F.min("extension").alias("extension"))


HEADS = (".rs", ".py", ".ts")


@query(f"WITH {_found_sql(*HEADS)} SELECT id, signature, regexp_matches(name, '^\\p{{Lu}}') AS upper, regexp_full_match(name, '\\w+') AS word, regexp_replace(file_path, '^1/', '') AS relative, regexp_replace(regexp_replace(return_type, '^Result<', ''), '>$', '') AS inner_type FROM found WHERE kind = 'function' AND signature IS NOT NULL")
def name_helpers(spark, sf):
    """Signatures are made again from the lines of the files that functions begin at."""
    # by its estimate, which is of the keys of part, the table of texts would be broadcast by way of the driver
    texts = sources(spark, sf, *HEADS).select(F.col("path").alias("file_path"), "content").hint("merge")
    rows = found(spark, sf, *HEADS, columns=("file_path", "id", "name", "return_type", "start_line", "end_line", "signature"), wanted=("function",)).where("signature IS NOT NULL").join(texts, "file_path")
    inner = F.regexp_replace(F.regexp_replace("return_type", "^Result<", ""), ">$", "")
    head = X.signature(X.lines_between(F.col("content"), F.col("start_line"), F.col("end_line")))
    return rows.select("id", head.alias("signature"), X.capital(F.col("name")).alias("upper"), X.word(F.col("name")).alias("word"), X.without_prefix(F.col("file_path"), "1").alias("relative"), inner.alias("inner_type"))


# The stand-in for an embedding model

WORDS = "words AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[ \t-\r]+'), w -> w <> '')) AS w FROM documents)".replace("w -> w", "lambda w: w")
EMBEDDED = f"{WORDS}, h AS (SELECT doc_id, md5(w) AS h FROM words), b AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 15)) AS BIGINT) % 64 AS bucket, sum(CASE WHEN substr(h, 16, 1) >= '8' THEN 1 ELSE -1 END) AS c FROM h GROUP BY ALL)"


@query(f"WITH {EMBEDDED}, n AS (SELECT doc_id, count(*) FILTER (c <> 0) AS used, sqrt(sum(c * c)) AS norm, max(abs(c)) AS most FROM b GROUP BY doc_id) SELECT d.doc_id, 64 AS dimension, coalesce(used, 0) AS used, CASE WHEN norm > 0 THEN round(most / norm, 3) ELSE 0.0 END AS most FROM documents d LEFT JOIN n USING (doc_id)")
def embed_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = V.embedded(docs, "text", V.hashing_embedder(64))
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return rows.select("doc_id", F.size("embedding").alias("dimension"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used"), F.round(most, 3).alias("most"))


@query(f"""WITH {EMBEDDED}, q AS (SELECT CAST(('0x' || substr(md5(w), 1, 15)) AS BIGINT) % 64 AS bucket, CASE WHEN substr(md5(w), 16, 1) >= '8' THEN 1 ELSE -1 END AS c FROM (VALUES ('the'), ('und'), ('los')) v(w)), n AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM b GROUP BY doc_id)
SELECT b.doc_id, round(sum(b.c * q.c) / any_value(norm) / (SELECT sqrt(sum(c * c)) FROM q), 3) AS score FROM b JOIN q USING (bucket) JOIN n USING (doc_id) WHERE norm > 0 AND b.c <> 0 GROUP BY b.doc_id""")
def search_documents(spark, sf):
    """The similarity of every document that shares a bucket with the question."""
    embed = V.hashing_embedder(64)
    asked = embed(["the UND los"])[0]
    used = [k for k, x in enumerate(asked) if x]
    rows = V.embedded(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text", embed)
    meets = F.exists(F.array(*[F.col("embedding")[k] != 0 for k in used]), lambda x: x)
    return rows.where(meets).select("doc_id", F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in asked])), 3).alias("score"))


def _hashed(table: str, key: str, dimension: int) -> str:
    """Buckets of the words of a table's texts: key, bucket, c."""
    words = f"SELECT {key}, md5(unnest(list_filter(string_split_regex(lower(content), '[ \\t-\\r]+'), lambda w: w <> ''))) AS h FROM {table}"
    return f"SELECT {key}, CAST(('0x' || substr(h, 1, 15)) AS BIGINT) % {dimension} AS bucket, sum(CASE WHEN substr(h, 16, 1) >= '8' THEN 1 ELSE -1 END) AS c FROM ({words}) GROUP BY ALL"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASKED = "async load rows for row in read"
#: Every fixture is short enough to be one chunk.
CHUNKED = ", ".join(f"({_quoted(p)}, {_quoted(c.strip())}, {len(c.splitlines())})" for p, c in FIXTURES.items() if c)


@query(f"""{{chunks}}, k AS (SELECT file_path || ':' || CAST(ordinal AS VARCHAR) AS k, content FROM chunks), b AS ({_hashed('k', 'k', 64)}), n AS (SELECT k, count(*) FILTER (c <> 0) AS used FROM b GROUP BY k)
SELECT file_path, ordinal, start_line, 64 AS dimension, coalesce(used, 0) AS used FROM chunks LEFT JOIN n ON n.k = file_path || ':' || CAST(ordinal AS VARCHAR)""")
def chunk_embeddings(spark, sf):
    """Every chunk of the documents with its own vector."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    files = spark.read.parquet(f"{sf}/documents.parquet").select(path.alias("path"), F.col("text").alias("content"))
    rows = V.embedded(chunking.chunks(files), "content", V.hashing_embedder(64))
    return rows.select("file_path", "ordinal", "start_line", F.size("embedding").alias("dimension"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used"))


@query(f"""WITH f(path, content, n) AS (VALUES {CHUNKED}), q(one, content) AS (VALUES (1, '{ASKED}')), b AS ({_hashed('f', 'path', 384)}), a AS ({_hashed('q', 'one', 384)}), norms AS (SELECT path, sqrt(sum(c * c)) AS norm FROM b GROUP BY path)
SELECT path, 1 AS start_line, any_value(n) AS end_line FROM b JOIN a USING (bucket) JOIN norms USING (path) JOIN f USING (path) GROUP BY path ORDER BY round(sum(b.c * a.c) / any_value(norm), 6) DESC, path LIMIT 3""")
def search_fixtures(spark, _):
    """The fixtures nearest to a question, best first, as lines of chunks."""
    embedder = V.hashing_embedder(384)
    chunks = chunking.chunks(fixtures(spark).where(corpus.indexable(F.col("path"))))
    hits = V.search_text(V.embedded(chunks, "content", embedder).withColumns({"entity_id": F.lit(None).cast("string"), "entity_type": F.lit("file")}), ASKED, embedder, 3)
    return hits.select("path", "start_line", "end_line")
