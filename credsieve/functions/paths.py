"""Column functions over file paths: classes, effective extension, globs, categories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path classes.
TEST_DIRS = ("test", "tests", "spec", "__tests__", "testing", "fixtures", "mocks")
TEST_NAMES = r"(_test\.|\.test\.|_spec\.|\.spec\.)|_test$|^test_|\.(test|spec)$"
CONFIG_EXTENSIONS = ("yml", "yaml", "toml", "ini", "conf", "config", "properties", "env", "json")
CONFIG_PARTS = r"/\.env|^\.env$|^\.env\.|config|\.npmrc$|\.dockerignore$|dockerfile"
DOC_EXTENSIONS = ("md", "markdown", "rst", "adoc")
DOC_PARTS = r"/docs/|/doc/|/examples/|readme|changelog|license"
EXAMPLE_PARTS = r"/example|/sample|/demo|example\.|sample\."
VENDOR_DIRS = ("vendor", "node_modules", "third_party", "external", r"\.cargo", "target", "build", "dist")
VENDOR_LEADING = ("vendor", "node_modules", "third_party", "external", "target", "build", "dist")
LOCKFILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "Pipfile.lock",
    "composer.lock", "go.sum", "flake.lock", "pubspec.lock", "packages.lock.json", "bun.lockb",
)
BINARY_EXTENSIONS = tuple(
    "exe dll so dylib bin com msi o a lib obj class pyc pyo elc beam zip tar gz bz2 xz 7z rar zst lz4 lzma jpg jpeg png gif bmp ico svg webp tiff avif mp3 mp4 avi mov mkv flac wav ogg webm woff woff2 ttf eot otf pdf doc docx xls xlsx ppt pptx dat db sqlite sqlite3 mdb parquet arrow iso img dmg vmdk map".split()
)


def _lower(path: Column) -> Column:
    return F.lower(path)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_ext(path: Column) -> Column:
    """.env and .env.* are ``env``; a dotfile without a second dot and a name without a dot have none (null)."""
    name = basename(path)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when((name == ".env") | name.startswith(".env."), "env").otherwise(F.when(ext != "", ext))


def is_test_file(path: Column) -> Column:
    p = _lower(path)
    return p.rlike("/(" + "|".join(TEST_DIRS) + ")/") | basename(p).rlike(TEST_NAMES)


def is_config_file(path: Column) -> Column:
    p = _lower(path)
    return F.coalesce(file_ext(p).isin(*CONFIG_EXTENSIONS), F.lit(False)) | p.rlike(CONFIG_PARTS)


def is_documentation(path: Column) -> Column:
    p = _lower(path)
    return F.coalesce(file_ext(p).isin(*DOC_EXTENSIONS), F.lit(False)) | p.rlike(DOC_PARTS)


def is_example(path: Column) -> Column:
    return _lower(path).rlike(EXAMPLE_PARTS)


def is_vendor(path: Column) -> Column:
    p = _lower(path)
    return p.rlike("/(" + "|".join(VENDOR_DIRS) + ")/") | p.rlike("^(" + "|".join(VENDOR_LEADING) + ")/")


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(*LOCKFILES)


def is_binary_name(path: Column) -> Column:
    return F.coalesce(F.lower(file_ext(path)).isin(*BINARY_EXTENSIONS), F.lit(False))


def relativize(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")


#: The wildcards of a glob: ** with the slash after it, * and ?.
_WILD = re.compile(r"(\*\*+/?|\*|\?)")


def split_glob(pattern: str) -> tuple[str, bool]:
    """A glob's body without the ** / before it that any suffix of a path stands for, and whether it is negated (by an odd number of !)."""
    body = pattern.lstrip("!")
    return body.removeprefix("**/"), (len(pattern) - len(body)) % 2 == 1


def glob_to_regex(pattern: str) -> tuple[str, bool]:
    """An anchored regular expression for a glob, and whether it is negated. * stays inside a directory, ** crosses them (and takes the slash after it along), ? is one character; a pattern without / is for the file name, one with / for the path or any suffix of it after a slash."""
    body, negated = split_glob(pattern)
    across = ".*" if "/" in pattern else "[^/]*"
    out = "".join(across if part.startswith("**") else {"*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)) for part in _WILD.split(body))
    return "(?s)(?:^|/)" + out + "\\z", negated


#: What marked puts before and after a path.
EDGES = "/", "\0"


def marked(path: Column) -> Column:
    """A path between EDGES, so that a glob's first and last literal runs are bound to a segment's start and the path's end."""
    return F.concat(F.lit(EDGES[0]), path, F.lit(EDGES[1]))


def literal_runs(pattern: str) -> list[str]:
    """Strings that marked paths hold where the glob's body matches; never empty, as the edges are among them."""
    runs = _WILD.split(EDGES[0] + split_glob(pattern)[0] + EDGES[1])[::2]
    return [r for r in runs if r]


def glob_match(path: Column, pattern: str) -> Column:
    regex, negated = glob_to_regex(pattern)
    return ~path.rlike(regex) if negated else path.rlike(regex)


def adjust_severity(severity: Column, is_doc: Column) -> Column:
    """One step down in documentation."""
    down = F.when(severity == "CRITICAL", "HIGH").when(severity == "HIGH", "MEDIUM").otherwise("LOW")
    return F.when(is_doc, down).otherwise(severity)


# Categories of type names, the first that fits.
CATEGORIES = (
    ("AWS", ("AWS",)), ("Google Cloud", ("GCP", "Firebase")), ("Azure", ("Azure",)), ("GitHub", ("GitHub",)), ("GitLab", ("GitLab",)),
    ("Private Keys", ("Private Key", "SSH")), ("Databases", ("Database", "Connection", "PlanetScale", "Supabase")),
    ("AI/ML", ("OpenAI", "Anthropic", "Cohere", "HuggingFace", "Replicate")), ("Package Registries", ("NPM", "PyPI", "NuGet", "RubyGems", "Docker Hub")),
    ("Communication", ("Discord", "Slack", "Telegram")), ("Payment/E-commerce", ("Stripe", "Shopify", "Square", "PayPal")),
    ("Monitoring/Observability", ("Datadog", "New Relic", "Sentry", "Grafana", "Elastic", "Algolia")),
    ("CI/CD & Hosting", ("CircleCI", "Travis", "Vercel", "Netlify", "Heroku")), ("Authentication", ("Okta", "Auth0", "JWT", "OAuth")),
    ("Cloud Services", ("Cloudflare", "DigitalOcean", "HashiCorp", "Linear", "Notion", "Airtable")),
)


def secret_category(name: Column) -> Column:
    out = F.lit("Other")
    for category, parts in reversed(CATEGORIES):
        fits = F.lit(False)
        for part in parts:
            fits = fits | name.contains(part)
        out = F.when(fits, category).otherwise(out)
    return out
