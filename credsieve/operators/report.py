"""Reports, comparisons, traces, verification by format, and remediation over flat findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as X
from ..sources.files import is_own_output
from .dictionary import contained
from .match import TRACE_ENTROPY, findings, scan_lines
from .suppress import likely_false_positive


def summary(found: DataFrame) -> DataFrame:
    """One row: findings by severity, validated ones, likely false positives."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    validated = F.count_if(F.col("validated")) if "validated" in found.columns else F.lit(0).cast("long")
    return found.agg(F.count("*").alias("total"), n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW"), validated.alias("validated"), F.count_if(likely_false_positive()).alias("false_positives"))


def json_report(found: DataFrame, version: str = "1.0") -> DataFrame:
    """The report as JSON lines (part, json): one envelope with version, total and summary, and one finding a row, so that no row grows with the report."""
    body = found.select(F.lit("finding").alias("part"), F.to_json(F.struct("display_name", "path", "line_number", "redacted_value", "severity", "confidence")).alias("json"))
    head = summary(found).select(F.lit("envelope").alias("part"), F.to_json(F.struct(F.lit(version).alias("version"), F.col("total").alias("total_findings"), F.struct("*").alias("summary"))).alias("json"))
    return head.union(body)


def sarif_rules(found: DataFrame) -> DataFrame:
    """One row per type: the first finding's severity decides the level."""
    order = F.struct("path", "line_number", "start")
    return found.groupBy("type_id").agg(F.min_by("display_name", order).alias("name"), F.min_by(sarif_level(F.col("severity")), order).alias("level"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def sarif_results(found: DataFrame) -> DataFrame:
    return found.select("type_id", sarif_level(F.col("severity")).alias("level"), F.col("path").alias("uri"), F.col("line_number").alias("start_line"), (F.col("start") + 1).alias("start_column"), (F.col("end") + 1).alias("end_column"))


def report_rows(found: DataFrame) -> DataFrame:
    return found.select("path", "line_number", "display_name", "redacted_value", "severity", F.round("confidence", 6).alias("confidence"), likely_false_positive().alias("false_positive"))


def webhook_payload(found: DataFrame, kind: str) -> DataFrame:
    """kind, n, more, items. Slack: the first 10 and how many more; teams: the first 20; by severity, path, line. generic: all with redacted values, one payload for each file."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    item = F.struct("r", "path", "line_number", "display_name", "severity", "redacted_value")
    shown = found.select(rank.alias("r"), "path", "line_number", "display_name", "severity", "redacted_value")
    limit = {"slack": 10, "teams": 20}.get(kind)
    if limit is None:
        paged = shown.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items"))
        return paged.select(F.lit(kind).alias("kind"), F.size("items").cast("long").alias("n"), F.lit(0).cast("long").alias("more"), F.to_json("items").alias("items"))
    items = shown.orderBy("r", "path", "line_number", "display_name", "redacted_value").limit(limit).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return items.crossJoin(found.agg(F.count("*").alias("n"))).select(F.lit(kind).alias("kind"), "n", F.greatest(F.lit(0), F.col("n") - F.size("items")).alias("more"), F.to_json("items").alias("items"))


def by_value(found: DataFrame) -> DataFrame:
    return found.groupBy("value").agg(F.count("*").alias("references"), F.count_distinct("path").alias("files"))


def by_category(rules: DataFrame) -> DataFrame:
    return rules.groupBy(P.secret_category(F.col("display_name")).alias("category")).agg(F.count_distinct("type_id").alias("types"), F.count("*").alias("patterns"))


def diff_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed or unchanged for every key of two reports (type, value, path, line); repeated keys count once."""
    keys = ["type_id", "value", "path", "line_number"]
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("unchanged").alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.agg(n("added"), n("removed"), n("unchanged")).withColumn("net", F.col("added") - F.col("removed"))


# ---- traces ----

# Where a leaked value reaches.
BLAST = (("environment", r"\.env$|\.env\.local$|\.env\.production$"), ("config", r"\.(toml|yaml|yml|json|ini|conf)$"), ("cicd", r"jenkinsfile|dockerfile|\.github/|\.gitlab-ci|\.circleci"), ("infrastructure", r"\.tf$|\.tfvars$|docker-compose|k8s|helm"))


def traceable(files: DataFrame) -> DataFrame:
    """Files that traces look at: all but reports of scans and pages, which repeat what was found elsewhere."""
    page = F.coalesce(P.file_ext(F.col("path")), F.lit("")) == "html"
    return files.filter(~page & ~is_own_output(F.col("path"), F.col("content")))


def trace_values(lines: DataFrame, values: DataFrame) -> DataFrame:
    """value, path, line_number of every line that holds one of the values (value): see dictionary.contained. Lines should come from traceable files."""
    return contained(lines.select("path", "line_number", "line"), values, "line").select("value", "path", "line_number")


def trace_type(found: DataFrame, part: str) -> DataFrame:
    return by_value(found.filter(F.contains(F.lower("display_name"), F.lit(part.lower()))))


def trace_file(lines: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """Where the secrets of one file are. Every line of it is asked, placeholders too."""
    return trace_values(lines, scan_lines(lines.filter(F.col("path") == path), rules).select("value"))


def trace_findings(lines: DataFrame, rules: DataFrame, placeholder: Callable[[Column], Column] = X.is_placeholder) -> DataFrame:
    """What traces by type look at: findings at the lower entropy threshold of traces."""
    return findings(lines, rules, TRACE_ENTROPY, placeholder)


def blast_radius(hits: DataFrame) -> DataFrame:
    """category, files, flag over the paths of a trace: [!!] above 3 files, [!] above 1, else [-]."""
    p = F.lower("path")
    kinds = F.filter(F.array(*[F.when(p.rlike(rx), F.lit(k)) for k, rx in BLAST]), lambda x: x.isNotNull())
    counted = hits.select("path", F.explode(kinds).alias("category")).groupBy("category").agg(F.count_distinct("path").alias("files"))
    return counted.withColumn("flag", F.when(F.col("files") > 3, "[!!]").when(F.col("files") > 1, "[!]").otherwise("[-]"))


# ---- verification ----

# Type, prefixes, least and greatest length of the whole value, characters (or pattern) of what follows the prefix.
FORMAT_RULES = r"""
AwsAccessKey AKIA,ASIA,AGPA,AIDA,AROA,AIPA,ANPA,ANVA,A3T 20 20 .
AwsSecretKey - 40 40 [A-Za-z0-9+/=]
AwsMwsKey amzn.mws. 45 9999 .
AwsBedrockApiKey AKIA,ASIA 20 20 [A-Z0-9]
GcpApiKey AIza 39 39 [A-Za-z0-9_-]
GoogleAiStudioKey AIza 39 39 [A-Za-z0-9_-]
GoogleMapsApiKey AIza 39 39 [A-Za-z0-9_-]
GcpServiceAccount - 0 9999 .*service_account.*
GcpApplicationDefaultCredentials - 0 9999 .*iam\.gserviceaccount\.com.*
AzureStorageKey - 0 9999 .*DefaultEndpointsProtocol=.*
AzureConnectionString - 0 9999 (?=.*(Server=|Data\x20Source=)).*(Password=|PWD=).*
AzureSasToken - 0 9999 (?=.*sig=).*&s.*
AzureDevOpsPat - 52 52 [A-Za-z0-9]
AzureContainerRegistryKey - 52 52 [A-Za-z0-9+/=]
AzureCosmosDbKey - 88 9999 .*AccountKey=.*
AzureFunctionKey - 40 9999 [A-Za-z0-9_/+=-]
AzureSearchAdminKey - 32 9999 [A-Za-z0-9]
AzureSearchQueryKey - 32 9999 [A-Za-z0-9]
AzureApiManagementKey - 32 9999 [A-Za-z0-9]
AzureAppConfigKey - 0 9999 (?=.*azconfig\.io).*Secret=.*
AzureBatchKey - 88 88 .*==
AzureOpenAiApiKey - 32 32 [a-f0-9]
AzureAdClientSecret - 34 9999 .*Q~.*
AlibabaAccessKey LTAI 24 24 [A-Za-z0-9]
AlibabaSecretKey - 30 9999 [A-Za-z0-9]
GitHubPat ghp_ 34 44 [A-Za-z0-9]
GitHubOauth gho_ 34 44 [A-Za-z0-9]
GitHubToken - 30 45 [A-Za-z0-9]
GitHubAppToken ghs_ 34 44 [A-Za-z0-9]
GitHubFineGrainedPat github_pat_ 93 93 [A-Za-z0-9_-]
GitLabPat glpat- 26 26 [A-Za-z0-9_-]
GitLabRunnerToken glrt- 25 9999 [A-Za-z0-9_-]
GitLabProjectToken - 0 9999 .*glpat-.*
BitbucketAppPassword - 18 9999 [A-Za-z0-9_-]
StripeApiKey sk_live_ 32 9999 [A-Za-z0-9]
StripeRestrictedKey rk_live_ 32 9999 [A-Za-z0-9]
PaystackSecretKey sk_live_,sk_test_ 40 9999 [A-Za-z0-9]
SquareAccessToken sq0atp- 29 29 [A-Za-z0-9_-]
BraintreeAccessToken access_token$ 60 9999 .
RazorpayKeyId rzp_live_,rzp_test_ 14 9999 .
FlutterwaveSecretKey FLWSECK 20 9999 .
FlutterwaveEncryptionKey FLWSECK 20 9999 .
FlutterwavePublicKey FLWPUBK 32 9999 .
AdyenApiKey AQE 80 9999 .
SendGridApiKey SG. 60 9999 .
TwilioApiKey SK 34 34 [0-9a-fA-F]
SlackToken xox 30 9999 .
SlackWebhook https://hooks.slack.com/ 0 9999 .
SlackAppToken xapp- 20 9999 .
SlackConfigToken xoxe. 20 9999 .
DiscordBotToken - 50 9999 .*\..*
DiscordWebhook https://discord 0 9999 .*/webhooks/.*
TelegramBotToken - 35 9999 .*:.*
MicrosoftTeamsWebhook - 0 9999 .*webhook\.office\.com.*
TelnyxApiKey KEY 50 9999 .
MailgunApiKey - 32 32 [a-f0-9]
MailchimpApiKey - 35 9999 .*-us.*
MailerSendApiKey mlsn. 69 9999 [a-f0-9]
MandrillApiKey - 22 22 [A-Za-z0-9_-]
ResendApiKey re_ 33 9999 [A-Za-z0-9_-]
OpenAiApiKey sk- 20 9999 [A-Za-z0-9_.-]
AnthropicApiKey sk-ant-api03- 103 9999 [A-Za-z0-9_-]
AnthropicAdminApiKey sk-ant-admin 32 9999 [A-Za-z0-9_-]
CohereApiKey - 40 40 [A-Za-z0-9]
HuggingFaceToken hf_ 37 9999 [A-Za-z0-9]
ReplicateApiKey r8_ 39 9999 [A-Za-z0-9]
GroqApiKey gsk_ 56 9999 [A-Za-z0-9]
PerplexityApiKey pplx- 53 53 [a-f0-9]
DeepSeekApiKey sk- 51 51 [a-f0-9]
MistralApiKey - 32 32 [A-Za-z0-9]
StabilityAiApiKey sk- 51 9999 [A-Za-z0-9]
TogetherAiApiKey - 64 64 [a-f0-9]
FireworksAiApiKey fw_ 43 9999 [A-Za-z0-9]
DatadogApiKey - 32 32 [a-f0-9]
DatadogAppKey - 40 40 [a-f0-9]
NewRelicApiKey NRAK- 32 32 [A-Z0-9]
NewRelicBrowserApiKey NRJS- 24 24 [a-f0-9]
NewRelicInsightsQueryKey NRIQ- 37 37 [A-Za-z0-9]
NewRelicLicenseKey - 44 9999 .*NRAL
SentryDsn https:// 0 9999 (?=.*@).*sentry\.io.*
GrafanaApiKey glc_,glsa_ 32 9999 .
PagerDutyApiKey - 20 9999 [A-Za-z0-9+/=]
SplunkHecToken - 36 36 UUID
DynatraceApiToken dt0c01. 80 9999 .
PosthogApiKey phx_,phc_ 40 9999 .
SumoLogicKey - 64 64 [A-Za-z0-9]
CloudflareApiToken - 40 9999 [A-Za-z0-9_-]
DigitalOceanToken dop_v1_ 71 71 [a-f0-9]
DigitalOceanOAuthToken doo_v1_ 71 71 [a-f0-9]
DigitalOceanRefreshToken dor_v1_ 71 71 [a-f0-9]
DigitalOceanSpacesKey DO 20 20 [A-Z0-9]
VercelToken - 24 24 [A-Za-z0-9]
HerokuApiKey - 36 36 UUID
NetlifyPat nfp_ 44 9999 [A-Za-z0-9]
FlyAccessToken - 40 9999 .*fm2_.*
FlyIoPersonalToken fo1_ 44 9999 [A-Za-z0-9_-]
RenderApiKey rnd_ 36 9999 [A-Za-z0-9]
DenoDeployToken ddp_ 44 44 [A-Za-z0-9]
DockerHubToken dckr_pat_ 36 9999 [A-Za-z0-9_-]
HashiCorpVaultToken hvs. 28 9999 [A-Za-z0-9_-]
VaultBatchToken hvb. 134 9999 [A-Za-z0-9_-]
TerraformCloudToken - 60 9999 .*atlasv1\..*
PulumiAccessToken pul- 44 44 [a-f0-9]
FastlyApiToken - 32 9999 [A-Za-z0-9_-]
DopplerToken dp. 40 9999 .
PlanetScaleToken pscale_tkn_ 41 9999 [A-Za-z0-9_-]
PlanetScalePassword pscale_pw_ 40 9999 [A-Za-z0-9_-]
InfracostApiKey ico- 36 36 [A-Za-z0-9]
RailwayApiToken - 36 36 [a-f0-9]
NeonApiKey - 60 9999 [A-Za-z0-9]
TurborepoAccessToken - 36 36 [A-Za-z0-9]
SonarQubeToken squ_ 44 44 [A-Za-z0-9]
UpstashRedisToken AX 60 9999 .
CircleCiToken - 40 40 [a-f0-9]
JiraApiToken - 24 9999 [A-Za-z0-9]
LaunchDarklyKey sdk- 36 9999 .
DatabricksToken dapi 36 36 [a-f0-9]
ConfluentApiKey - 16 16 [A-Za-z0-9]
OktaApiToken 00 40 9999 [A-Za-z0-9_-]
PostmanApiToken PMAK- 60 9999 .
SnykApiToken - 36 36 UUID
CodecovAccessToken - 32 32 [A-Za-z0-9]
BuildKiteApiToken bkua_ 45 45 [a-f0-9]
PrefectApiToken pnu_ 40 40 [A-Za-z0-9]
HarnessPat pat. 60 9999 .
ScalingoApiToken tk-us- 54 54 [A-Za-z0-9_-]
SourcegraphAccessToken sgp_ 44 9999 [0-9a-fA-F]
TailscaleApiKey tskey- 26 9999 [A-Za-z0-9_-]
BeamerApiToken - 44 9999 .*b_.*
LinearApiKey lin_api_ 48 9999 [A-Za-z0-9]
NotionApiKey ntn_,secret_ 40 9999 .
AirtableApiKey pat 0 9999 .*\..*
ShopifyApiKey shpat_,shpca_ 38 9999 .
ShopifyAccessToken shpat_,shpca_ 38 9999 .
ShopifySharedSecret shpss_ 38 38 [0-9a-fA-F]
FigmaPat figd_ 45 9999 [A-Za-z0-9_-]
AsanaSecret - 16 9999 [A-Za-z0-9]
TrelloAccessToken - 32 32 [A-Za-z0-9]
TypeformApiToken tfp_ 44 9999 [A-Za-z0-9_-]
MapboxToken sk.eyJ,pk.eyJ 50 9999 .
SegmentWriteKey - 32 32 [A-Za-z0-9]
PlaidClientSecret - 30 30 [a-f0-9]
ContentfulApiToken - 43 43 [A-Za-z0-9_=-]
IntercomAccessToken - 60 9999 [A-Za-z0-9_=-]
NpmToken npm_ 40 9999 [A-Za-z0-9]
PyPiApiToken pypi-AgEIcHlwaS5vcmc 70 9999 [A-Za-z0-9_-]
NuGetApiKey oy2 46 46 [A-Za-z0-9]
RubyGemsApiKey rubygems_ 57 57 [a-f0-9]
CratesIoApiToken cio 35 35 [A-Za-z0-9]
ClojarsApiToken CLOJARS_ 60 9999 .
CocoaPodsToken - 32 32 [a-f0-9]
ComposerApiToken - 32 9999 [A-Za-z0-9]
HexPmApiKey - 64 9999 [A-Za-z0-9]
CargoRegistryToken - 32 9999 [A-Za-z0-9_-]
RsaPrivateKey - 0 9999 .*BEGIN\x20RSA\x20PRIVATE\x20KEY.*
SshPrivateKey - 0 9999 .*BEGIN\x20OPENSSH\x20PRIVATE\x20KEY.*
PgpPrivateKey - 0 9999 .*BEGIN\x20PGP\x20PRIVATE\x20KEY.*
EcPrivateKey - 0 9999 .*BEGIN\x20EC\x20PRIVATE\x20KEY.*
Pkcs8PrivateKey - 0 9999 .*BEGIN\x20PRIVATE\x20KEY.*
DsaPrivateKey - 0 9999 .*BEGIN\x20DSA\x20PRIVATE\x20KEY.*
OpensslPrivateKey - 0 9999 .*BEGIN.*PRIVATE\x20KEY.*
EncryptedPrivateKey - 0 9999 .*BEGIN\x20ENCRYPTED\x20PRIVATE\x20KEY.*
PuttyPrivateKey PuTTY-User-Key-File- 0 9999 .
"""
UUID = "(?=([^-]*-){4}[^-]*$)[0-9a-fA-F-]*"
FORMAT = "type_id string, prefixes array<string>, min_len int, max_len int, body_regex string"


def format_rules(spark: SparkSession) -> DataFrame:
    rows = [x.split() for x in FORMAT_RULES.strip().splitlines()]
    body = lambda c: f"(?s)^({UUID if c == 'UUID' else c + '*' if c == '.' or c.endswith(']') else c})$"
    return spark.createDataFrame([(t, [] if p == "-" else p.split(","), int(a), int(b), body(c)) for t, p, a, b, c in rows], FORMAT)


def verify_format(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds validated: does the value have its type's format? Of types without a rule, session tokens never have; connection strings need :// and 10 bytes, others 8 or more bytes without white space."""
    v, n = F.col("value"), F.octet_length("value")
    prefix = F.get(F.filter("prefixes", lambda p: F.startswith(v, p)), 0)
    body = F.call_function("substring", v, F.coalesce(F.length(prefix), F.lit(0)) + 1)
    ruled = ((F.size("prefixes") == 0) | prefix.isNotNull()) & n.between(F.col("min_len"), F.col("max_len")) & F.regexp_like(body, F.col("body_regex"))
    conn = F.contains(v, F.lit("://")) & (n >= 10)
    valid = F.when(F.col("body_regex").isNotNull(), ruled).when(F.col("type_id") == "AwsSessionToken", False).when(F.col("is_conn_string"), conn).otherwise((n >= 8) & ~v.rlike(r"[ \t\n\r\f]"))
    return found.join(F.broadcast(rules), "type_id", "left").withColumn("validated", valid).drop("prefixes", "min_len", "max_len", "body_regex")


def pair_credentials(found: DataFrame) -> DataFrame:
    """path, access_key, secret_key: the first of each in a file."""
    first = lambda t, name: found.filter(F.col("type_id") == t).groupBy("path").agg(F.min_by("value", F.struct("line_number", "start")).alias(name))
    return first("AwsAccessKey", "access_key").join(first("AwsSecretKey", "secret_key"), "path")


# Providers whose types have a check of their own.
DEDICATED = ("Aws", "GitHub", "GitLab", "Slack", "Stripe", "OpenAi", "Anthropic", "SendGrid", "Datadog", "HuggingFace", "DigitalOcean", "Twilio", "Npm", "Discord", "Telegram", "PyPi", "Shopify", "Linear", "NewRelic")


def dedicated(type_id: Column) -> Column:
    """True for types of a provider with a check of its own."""
    return type_id.rlike("^(" + "|".join(DEDICATED) + ")[A-Z]")


# Types that a service's own interface can check.
SERVICES = tuple(
    "CloudflareApiToken VercelToken NetlifyPat NetlifyToken HerokuApiKey RenderApiKey HetznerApiToken VultrApiKey LinodeApiToken ScalewayApiKey CohereApiKey ReplicateApiKey GroqApiKey MistralApiKey PerplexityApiKey DeepgramApiKey AssemblyAiApiKey ElevenLabsApiKey WandBApiKey MailgunApiKey PostmarkApiToken BrevoApiKey ResendApiKey MailerSendApiKey MandrillApiKey SparkPostApiKey VonageApiKey MessageBirdApiKey NotionApiKey AirtableApiKey AirtableOAuthToken AsanaSecret AsanaClientId ClickUpPersonalToken FigmaPat TodoistApiKey TypeformApiToken IntercomAccessToken FreshdeskApiKey WrikeApiToken BitbucketAppPassword BitbucketToken CircleCiToken CircleCiPersonalToken TravisCiApiToken TravisCiToken BuildKiteApiToken PostmanApiToken CodecovAccessToken SnykApiToken SonarQubeToken PagerDutyApiKey PosthogApiKey BugSnagApiKey RollbarApiKey HoneycombApiKey HubSpotApiKey HubSpotPrivateAppToken ConvertKitApiKey KlaviyoApiKey MapboxToken FaunaDbApiKey PlanetScaleToken PlanetScalePassword NeonApiKey AivenApiToken InfluxDbToken SquareAccessToken SquareOAuthToken CoinbaseAccessToken GoCardlessApiToken PaddleApiKey LemonSqueezyApiKey RecurlyApiKey ContentfulApiToken StoryblokApiToken WebflowApiToken LaunchDarklyKey FastlyApiToken AlgoliaApiKey TwilioAuthToken BrowserStackAccessKey ShodanApiKey FullStoryApiKey SalesforceApiToken JFrogIdentityToken DatabricksToken SourcegraphAccessToken".split()
)


def verification_tier(type_id: Column, services: Iterable[str] = SERVICES) -> Column:
    """2 for types in services, 1 for other types of a provider with a check of its own, 3 (format only) for the rest. Tiers 1 and 2 need a network."""
    return F.when(type_id.isin(*services), 2).when(dedicated(type_id), 1).otherwise(3)


# How to rotate a type.
ROTATION = {
    "AwsAccessKey": "aws iam create-access-key && aws iam delete-access-key --access-key-id <OLD_KEY>",
    "AwsSecretKey": "aws iam create-access-key && aws iam delete-access-key --access-key-id <OLD_KEY>",
    "GitHubPat": "gh auth refresh-token  (or regenerate at github.com/settings/tokens)",
    "GitHubToken": "gh auth refresh-token  (or regenerate at github.com/settings/tokens)",
    "GitLabPat": "Regenerate at gitlab.com/-/profile/personal_access_tokens",
    "StripeApiKey": "Regenerate at dashboard.stripe.com/apikeys (roll key)",
    "SlackToken": "Regenerate at api.slack.com/apps (reinstall app)",
    "SendGridApiKey": "Regenerate at app.sendgrid.com/settings/api_keys",
    "OpenAiApiKey": "Regenerate at platform.openai.com/api-keys",
    "AnthropicApiKey": "Regenerate at console.anthropic.com/settings/keys",
    "HuggingFaceToken": "Regenerate at huggingface.co/settings/tokens",
    "DigitalOceanToken": "Regenerate at cloud.digitalocean.com/account/api/tokens",
    "DockerHubToken": "Regenerate at hub.docker.com/settings/security",
    "DatadogApiKey": "Regenerate at app.datadoghq.com/organization-settings/api-keys",
    "DiscordBotToken": "Regenerate at discord.com/developers/applications",
    "TelegramBotToken": "Regenerate via @BotFather on Telegram",
    "TwilioApiKey": "Regenerate at twilio.com/console",
    "NpmToken": "npm token revoke <TOKEN> && npm token create",
    "HashiCorpVaultToken": "vault token revoke <TOKEN> && vault token create",
    "RsaPrivateKey": "Generate new key pair: ssh-keygen -t ed25519",
    "SshPrivateKey": "Generate new key pair: ssh-keygen -t ed25519",
    "EcPrivateKey": "Generate new key pair: ssh-keygen -t ed25519",
    "Pkcs8PrivateKey": "Generate new key pair: ssh-keygen -t ed25519",
    "DsaPrivateKey": "Generate new key pair: ssh-keygen -t ed25519",
}


def remediation_plan(found: DataFrame) -> DataFrame:
    """path, line_number, type_id, step, action: rotate, clean the history (values over 8 bytes), add to the ignore file."""
    spark = found.sparkSession
    advice = spark.createDataFrame(list(ROTATION.items()), "type_id string, rotation string")
    steps = F.filter(
        F.array(F.concat(F.lit("rotate: "), F.coalesce("rotation", F.lit("see the provider's documentation"))), F.when(F.octet_length("value") > 8, F.lit("remove the value from history")), F.concat(F.lit("ignore: fingerprint:"), "fingerprint")),
        lambda x: x.isNotNull(),
    )
    planned = found.join(F.broadcast(advice), "type_id", "left").select("path", "line_number", "type_id", F.posexplode(steps).alias("_i", "action"))
    return planned.select("path", "line_number", "type_id", (F.col("_i") + 1).alias("step"), "action")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line_number", "start", "rule_ord")


def newest(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.col("commit_date").desc(), "commit_hash").limit(n)
