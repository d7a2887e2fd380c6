"""Path rules as columns: classification, ingestion policy, excludes, path-like queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from .text import strip

#: Languages by suffix, of classification and of the file adapter.
LANGUAGES = {".ts": "typescript", ".js": "javascript", ".ejs": "ejs", ".md": "markdown", ".py": "python", ".tsx": "typescript", ".jsx": "javascript"}
#: Buckets by source type.
BUCKET_BY_TYPE = {
    "source_code": "code", "test_code": "code", "architecture_docs": "knowledge", "technical_docs": "knowledge",
    "requirements": "knowledge", "policies": "lis", "procedures": "lis", "configuration": "knowledge",
}
#: The ingestion policy.
SECRET_NAMES = (
    ".env", ".env.local", ".env.production", ".env.development", ".env.staging", ".env.test", ".npmrc", "credentials.json", "service-account.json",
    "secrets.yaml", "secrets.yml", "local.settings.json", "kubeconfig", "id_rsa", "id_ed25519", "id_dsa", "id_ecdsa",
)
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".ovpn", ".p8")
ALLOWED_SUFFIXES = (
    ".md", ".txt", ".py", ".ts", ".tsx", ".js", ".jsx", ".ejs", ".json", ".yaml", ".yml", ".toml", ".rst", ".csv", ".rs", ".swift", ".metal",
    ".c", ".h", ".m", ".cs", ".vue", ".html", ".sql", ".sh", ".bicep", ".bicepparam", ".pdf", ".docx", ".sru",
)
MAX_FILE_BYTES = 2_000_000
#: Suffixes that make a change look like a path.
PATH_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".md", ".ejs", ".json", ".yml", ".yaml")


@dataclass(frozen=True)
class PathPolicy:
    secret_names: tuple[str, ...] = SECRET_NAMES
    secret_suffixes: tuple[str, ...] = SECRET_SUFFIXES
    allowed_suffixes: tuple[str, ...] = ALLOWED_SUFFIXES
    max_bytes: int = MAX_FILE_BYTES
    allow_symlinks: bool = False

    def extended(self, names: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> PathPolicy:
        """With further deny rules."""
        return PathPolicy((*self.secret_names, *map(str.lower, names)), (*self.secret_suffixes, *map(str.lower, suffixes)), self.allowed_suffixes, self.max_bytes, self.allow_symlinks)


def normal(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last suffix in lower case, empty for names that only begin or end with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(names, suffix(path))


def bucket_of(source_type: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in BUCKET_BY_TYPE.items() for x in kv)), source_type)


def classify(path: Column, bucket: Column, config: Config) -> Column:
    """struct(type, app, language, file): by bucket, else README and documentation prefixes, else the longest app prefix."""
    file = normal(path)
    lang = language(file)
    doc = F.lower(basename(file)) == "readme.md"
    for prefix in config.documentation_prefixes:
        prefix = prefix.replace("\\", "/")
        doc = doc | F.startswith(file, F.lit(prefix if prefix.endswith("/") else prefix + "/"))
    app = F.lit(None).cast("string")
    for rule in sorted(config.apps, key=lambda r: len(r.prefix)):
        app = F.when(F.startswith(file, F.lit(rule.prefix.replace("\\", "/"))), F.lit(rule.name)).otherwise(app)
    whole = (F.coalesce(bucket, F.lit("")).isin("lis", "knowledge")) | doc
    kind = F.when(bucket == "lis", "lis").when(whole, "documentation").when(F.arrays_overlap(F.split(file, "/"), F.array(F.lit("test"), F.lit("tests"))), "test").otherwise("code")
    return F.struct(
        kind.alias("type"),
        F.when(whole, F.lit("global")).otherwise(F.coalesce(app, F.lit("global"))).alias("app"),
        F.when(whole, F.coalesce(lang, F.lit("markdown"))).otherwise(lang).alias("language"),
        file.alias("file"),
    )


def deny_reason(path: Column, size: Column, policy: PathPolicy | None = None, roots: tuple[str, ...] | None = None) -> Column:
    """Why a file isn't read, null if it is; the first reason in this order: root, secret, suffix, size."""
    policy = policy or PathPolicy()
    name, ext = F.lower(basename(path)), suffix(path)
    reason = F.lit(None).cast("string")
    reason = F.when(size > policy.max_bytes, "too large").otherwise(reason)
    reason = F.when((ext != "") & ~ext.isin(*policy.allowed_suffixes), "suffix not allowed").otherwise(reason)
    reason = F.when(name.isin(*policy.secret_names) | ext.isin(*policy.secret_suffixes), "secret").otherwise(reason)
    if roots is not None:
        inside = F.lit(False)
        for root in roots:
            root = root.rstrip("/")
            inside = inside | (path == root) | F.startswith(path, F.lit(root + "/"))
        escapes = F.array_contains(F.split(path, "/"), "..")
        reason = F.when(~inside | escapes, "outside the roots").otherwise(reason)
    return reason


def glob_pattern(glob: str) -> str:
    """fnmatch as a pattern of Java: * and ? cross slashes, [] are classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end
        else:
            out += re.escape(c) if c.isascii() and not c.isalnum() else c
        i += 1
    return f"(?s)^{out}$"


def path_glob_pattern(glob: str) -> str:
    """A path glob: * and ? stay within a component, ** spans any number of them."""
    parts = []
    for part in glob.replace("\\", "/").split("/"):
        parts.append("**" if part == "**" else re.sub(r"\\\*", "[^/]*", re.escape(part)).replace(r"\?", "[^/]"))
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        out += (".*" if last else "(?:[^/]+/)*") if part == "**" else part + ("" if last else "/")
    return f"^{out}$"


def excluded(path: Column, rules: tuple[str, ...]) -> Column:
    """Globs and rules with a slash match the whole path; bare rules match any component."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules if r and r.strip()):
        if any(c in rule for c in "*?[/\\"):
            out = out | F.rlike(path, F.lit(glob_pattern(rule.replace("\\", "/"))))
        else:
            out = out | F.array_contains(F.split(path, "/"), rule)
    return out


def ignored(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)


def looks_like_path(value: Column) -> Column:
    text = strip(F.coalesce(value, F.lit("")))
    file = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("/")), r"^\./", "")
    ends = F.rlike(file, F.lit("(" + "|".join(re.escape(s) for s in PATH_SUFFIXES) + r")\z"))
    fine = (text != "") & ~F.contains(text, F.lit("\n")) & (F.length(text) <= 260)
    return fine & (ends | (F.contains(file, F.lit("/")) & ~F.contains(file, F.lit(" "))))


def parent_prefix(path: Column) -> Column:
    """The directory of a path, with its slash; empty if it has none."""
    return F.regexp_extract(normal(path), r"^(.*/)[^/]*$", 1)


def clean_prefix(prefix: str | None) -> str:
    """A prefix filter without leading ./ and with forward slashes."""
    prefix = (prefix or "").replace("\\", "/")
    while prefix.startswith("./"):
        prefix = prefix[2:]
    return prefix
