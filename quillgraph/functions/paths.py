"""Paths, file classes and languages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a walk skips, and what names and extensions say about a file.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "bower_components", "vendor", ".pnpm-store", "dist", "build", "out", "target", ".next",
    ".nuxt", ".turbo", ".svelte-kit", ".dart_tool", "coverage", ".cache", ".pytest_cache", ".mypy_cache", ".gradle", "__pycache__", ".venv", "venv", ".workspace",
)
LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "composer.lock", "gemfile.lock", "poetry.lock", "pubspec.lock", "cargo.lock", "go.sum")
IGNORED_SUFFIXES = (".lock", ".min.js", ".min.css", ".map", ".tsbuildinfo")
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".d.ts": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyi": "python", ".go": "go", ".java": "java", ".dart": "dart", ".rs": "rust",
}
DOCUMENTS = (".md", ".mdx", ".markdown", ".rst", ".adoc")
CONFIGURATION = (".json", ".jsonc", ".json5", ".yaml", ".yml", ".toml", ".ini", ".conf", ".properties", ".editorconfig")
SCHEMAS = (".graphql", ".gql", ".proto", ".prisma", ".avsc")
DATABASES = (".sql", ".ddl", ".psql")
BINARIES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".bmp", ".ico", ".icns", ".svgz", ".pdf", ".zip", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war",
    ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4", ".wav", ".ogg", ".webm", ".mov", ".avi", ".wasm", ".so", ".dylib", ".dll", ".exe", ".bin", ".dat", ".db",
    ".sqlite", ".class", ".pyc", ".o", ".a", ".node", ".scip",
)
BY_NAME = {
    "package.json": "package-manifest", "tsconfig.json": "typescript-config", "jsconfig.json": "javascript-config", "dockerfile": "dockerfile", "containerfile": "dockerfile",
    "docker-compose.yml": "compose", "docker-compose.yaml": "compose", "compose.yml": "compose", "compose.yaml": "compose", "procfile": "tooling-config", "makefile": "tooling-config",
}
SPEC_STEMS = ("openapi", "swagger", "asyncapi", "api")
VENDOR_SEGMENTS = ("vendor", "third_party", "thirdparty", "external", "node_modules")
GENERATED_SEGMENTS = ("generated", "__generated__", ".generated", "gen")
GENERATED_SUFFIXES = (".generated.ts", ".generated.js", ".gen.ts", ".gen.go", ".pb.go", ".pb.ts", "_pb2.py", ".min.js", ".min.css", ".snap", ".map", ".tsbuildinfo")
EXAMPLE_ENV = (".example", ".sample", ".template", ".defaults", ".dist")
TOOLING_SUFFIXES = (".config.ts", ".config.js", ".config.mjs", ".config.cjs")
SOURCE_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".jsonc", ".prisma", ".sql", ".ddl", ".psql", ".yml", ".yaml", ".md", ".mdx")
SOURCE_NAMES = ("dockerfile", "procfile", "makefile")
NOT_SOURCE = (".min.js", ".d.ts.map", ".js.map", ".tsbuildinfo")
ANALYSABLE = ("code", "document", "configuration", "schema", "database")


def ends(c: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | c.endswith(s)
    return out


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    """The path before the last slash, '' at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestor_paths(path: Column) -> Column:
    """All directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def truncate_middle(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; .d.ts is one; null for none or a leading dot only."""
    name = F.lower(file_name(path))
    return F.when(name.endswith(".d.ts"), ".d.ts").otherwise(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"(\.[^.]*)$", 1)))


def language(path: Column) -> Column:
    """The language that the extension names."""
    lower = F.lower(path)
    ext = F.when(lower.endswith(".d.ts"), ".d.ts").otherwise(F.regexp_extract(lower, r"^.+?(\.[^.]*)$", 1))
    return F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in LANGUAGES.items()])


def is_ignored(path: Column) -> Column:
    """True for files under an ignored directory, lock files and generated suffixes."""
    lower = F.lower(path)
    folders = F.slice(F.split(lower, "/"), 1, F.greatest(F.size(F.split(lower, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in IGNORED_DIRECTORIES])) | file_name(lower).isin(*LOCK_FILES) | ends(lower, IGNORED_SUFFIXES)


def is_indexed_source(path: Column) -> Column:
    """True for paths whose text is read."""
    lower = F.lower(path)
    name = file_name(lower)
    return ~ends(lower, NOT_SOURCE) & (name.isin(*SOURCE_NAMES) | name.startswith(".env") | ends(lower, SOURCE_SUFFIXES))


def holds_secrets(path: Column) -> Column:
    """A live .env file: recorded, never read."""
    name = F.lower(file_name(path))
    return name.startswith(".env") & ~ends(name, EXAMPLE_ENV)


def classify(path: Column) -> Column:
    """struct(category, role, language, extension) of a path, from its name alone."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    lower = F.lower(posix)
    name = file_name(lower)
    ext = F.coalesce(extension(posix), F.lit(""))
    folders = F.slice(F.split(lower, "/"), 1, F.greatest(F.size(F.split(lower, "/")) - 1, F.lit(0)))
    within = lambda names: F.arrays_overlap(folders, F.array(*[F.lit(x) for x in names]))
    stem = F.when(F.length(ext) > 0, F.substring(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    structured = ext.isin(".json", ".yaml", ".yml")
    spec = structured & (stem.isin(*SPEC_STEMS) | stem.startswith("openapi") | stem.startswith("swagger") | stem.startswith("asyncapi"))
    json_schema = structured & ends(stem, (".schema", "-schema", ".jsonschema"))
    joined = F.concat(F.lit("/"), F.array_join(folders, "/"), F.lit("/"))
    ci = ext.isin(".yaml", ".yml") & (joined.contains("/.github/workflows/") | joined.contains("/.gitlab/") | joined.contains("/.circleci/") | joined.contains("/.buildkite/") | (F.array_contains(folders, ".github") & F.array_contains(folders, "workflows")))
    tooling = (F.instr(posix, "/") == 0) & ends(name, TOOLING_SUFFIXES)
    env = name.startswith(".env") | (name == "env.example")
    example = (name == "env.example") | ends(name, EXAMPLE_ENV)
    migration = F.when(F.array_contains(folders, "migrations") | F.array_contains(folders, "migration"), "migration").otherwise("sql-schema")
    none = F.lit(None).cast("string")
    rules = [
        (name.isin(*LOCK_FILES), "generated", F.lit("lockfile")),
        (within(VENDOR_SEGMENTS), "vendor", none),
        (within(GENERATED_SEGMENTS) | ends(name, GENERATED_SUFFIXES), "generated", none),
        (ext.isin(*BINARIES), "binary", none),
        (name.isin(*BY_NAME), "configuration", F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in BY_NAME.items()])),
        (env, "configuration", F.when(example, "env-example").otherwise("env")),
        (name.startswith("dockerfile"), "configuration", F.lit("dockerfile")),
        (name.startswith("tsconfig.") & name.endswith(".json"), "configuration", F.lit("typescript-config")),
        (ext.isin(*DOCUMENTS), "document", F.when(name.startswith("readme."), "readme").otherwise("documentation")),
        (ext.isin(*DATABASES), "database", migration),
        (ext.isin(*SCHEMAS), "schema", none),
        (spec, "schema", F.lit("api-spec")),
        (json_schema, "schema", F.lit("json-schema")),
        (ext.isin(*CONFIGURATION), "configuration", F.when(ci, "ci-workflow")),
        (ext.isin(*LANGUAGES), "code", F.when(tooling, "tooling-config")),
        ((ext == "") & name.isin("readme", "license"), "document", F.when(name == "readme", "readme").otherwise("documentation")),
    ]
    category = role = None
    for test, c, r in rules:
        category = F.when(test, c) if category is None else category.when(test, c)
        role = F.when(test, r) if role is None else role.when(test, r)
    return F.struct(category.otherwise("unknown").alias("category"), role.otherwise(none).alias("role"), language(posix).alias("language"), F.when(ext != "", ext).alias("extension"))


def summarize(files: DataFrame) -> DataFrame:
    """Files per language and per category; ``files`` has a column path."""
    c = files.select(classify(F.col("path")).alias("c")).select("c.category", "c.language")
    by = lambda k: c.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("value")).agg(F.count("*").alias("files")).select(F.lit(k).alias("kind"), "value", "files")
    return by("category").unionByName(by("language"))


def detect_language(files: DataFrame) -> DataFrame:
    """Languages by score: their sources, plus marker files; highest first, then by name.

    tsconfig.json counts only where there are TypeScript sources.
    """
    c = files.select(F.lower(file_name(F.col("path"))).alias("name"), classify(F.col("path")).alias("c"))
    per = c.filter("c.category = 'code' AND c.language IS NOT NULL").groupBy(F.col("c.language").alias("language")).agg(F.count("*").alias("sources"))
    marks = c.agg(F.max((F.col("name") == "tsconfig.json").cast("int")).alias("ts"), F.max((F.col("name") == "package.json").cast("int")).alias("pkg"), F.max((F.col("name") == "jsconfig.json").cast("int")).alias("js"))
    bonus = F.when(F.col("language") == "typescript", 50 * F.col("ts")).when(F.col("language") == "javascript", 20 * F.col("pkg") + 15 * F.col("js")).otherwise(0)
    return per.join(marks, F.lit(True)).select("language", "sources", (F.col("sources") + bonus).cast("long").alias("score")).orderBy(F.desc("score"), "language")
