"""Markers of application stacks: what a line of code says about entries, writes, messages, calls and validation (§2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.linescan import Rule, scan_rules

#: Checks of beans, as a pattern and as needles.
BEAN = r"@(NotNull|NotBlank|NotEmpty|Size|Min|Max|DecimalMin|DecimalMax|Pattern|Email|Positive|PositiveOrZero|Negative|NegativeOrZero|Past|Future|Digits|AssertTrue)\b"
BEANS = ("@notnull", "@notblank", "@notempty", "@size", "@min", "@max", "@decimalmin", "@decimalmax", "@pattern", "@email", "@positive", "@negative", "@past", "@future", "@digits", "@asserttrue")

#: Kind, pattern and needles of each stack's markers; a pattern's group names what is entered.
MARKERS: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "spring": [
        ("entry-http", r'@(Get|Post|Put|Delete|Patch)Mapping\b(?:\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)")?', ("mapping",)),
        ("entry-amq", r'@JmsListener\s*\(\s*destination\s*=\s*"([^"]+)"', ("@jmslistener",)),
        ("db-write", r"\.(save|saveAll|saveAndFlush|delete|deleteById|deleteAll|deleteAllById|persist|merge|remove)\s*\(|@Modifying|jdbcTemplate\.(update|batchUpdate)\s*\(", (".save", ".delete", ".persist", ".merge", ".remove", "@modifying", "jdbctemplate.")),
        ("amq-publish", r"\.(convertAndSend|send)\s*\(", (".convertandsend", ".send")),
        ("http-out", r"restTemplate\.|\bRestTemplate\b|\bWebClient\b|webClient\.|@FeignClient|\bRestClient\b", ("resttemplate", "webclient", "@feignclient", "restclient")),
        ("validation", BEAN, BEANS),
    ],
    "quarkus": [
        ("entry-http", r"@(GET|POST|PUT|DELETE|PATCH)\b", ("@get", "@post", "@put", "@delete", "@patch")),
        ("entry-amq", r'@Incoming\s*\(\s*"([^"]+)"', ("@incoming",)),
        ("db-write", r"\.(persist|persistAndFlush|delete|deleteById|deleteAll|merge|remove)\s*\(|\.update\s*\(\s*\"", (".persist", ".delete", ".merge", ".remove", ".update")),
        ("amq-publish", r"\.send\s*\(|@Outgoing\s*\(", (".send", "@outgoing")),
        ("http-out", r"@RestClient\b|RestClientBuilder|\bWebClient\b|Client\.\w+\s*\(", ("restclient", "webclient", "client.")),
        ("validation", BEAN, BEANS),
    ],
    "aspnetcore": [
        ("entry-http", r'\[Http(Get|Post|Put|Delete|Patch)(?:\s*\(\s*"([^"]*)"\s*\))?\]|\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*"([^"]+)"', ("[http", ".map")),
        ("entry-amq", r'GetQueue\s*\(\s*"([^"]+)"|GetTopic\s*\(\s*"([^"]+)"|ReceiveEndpoint\s*\(\s*"([^"]+)"|IConsumer<(\w+)>', ("getqueue", "gettopic", "receiveendpoint", "iconsumer<")),
        ("db-write", r"SaveChanges(Async)?\s*\(|\.(Add|AddAsync|AddRange|AddRangeAsync|Update|UpdateRange|Remove|RemoveRange)\s*\(|ExecuteSql(Raw|Interpolated)|ExecuteUpdate|ExecuteDelete", ("savechanges", ".add", ".update", ".remove", "execute")),
        ("amq-publish", r"\.(Send|SendAsync|Publish|PublishAsync)\s*\(|CreateProducer\s*\(", (".send", ".publish", "createproducer")),
        ("http-out", r"\bHttpClient\b|\.(GetAsync|PostAsync|PutAsync|DeleteAsync|SendAsync|GetFromJsonAsync|PostAsJsonAsync|PutAsJsonAsync|GetStringAsync)\s*[<(]", ("httpclient", "async")),
        ("validation", r"RuleFor\s*\(|\[(Required|StringLength|Range|RegularExpression|MaxLength|MinLength|EmailAddress|Url|Phone|Compare)\b", ("rulefor", "[required", "[stringlength", "[range", "[regularexpression", "[maxlength", "[minlength", "[emailaddress", "[url", "[phone", "[compare")),
    ],
    "python": [
        ("entry-http", r"@\w+\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']|@\w+\.route\s*\(\s*[\"']([^\"']+)[\"']", ("@",)),
        ("entry-amq", r"create_receiver\s*\([^,]+,\s*[\"']([^\"']+)[\"']|\.subscribe\s*\(\s*destination\s*=\s*[\"']([^\"']+)[\"']", ("create_receiver", ".subscribe")),
        ("db-write", r"session\.(add|add_all|delete|merge|commit|flush)\s*\(|\.execute\s*\(\s*[\"'](INSERT|UPDATE|DELETE)|\.commit\s*\(", ("session.", ".execute", ".commit")),
        ("amq-publish", r"\.send\s*\(|\.publish\s*\(", (".send", ".publish")),
        ("http-out", r"\b(httpx|requests|aiohttp)\.|\bhttpx\.(Async)?Client\b", ("httpx.", "requests.", "aiohttp.")),
        ("validation", r"\bField\s*\(|@(field_)?validator\b|\b(constr|conint|confloat|conlist|condecimal)\s*\(", ("field", "validator", "constr", "conint", "confloat", "conlist", "condecimal")),
    ],
}


def marked(lines: DataFrame, stacks: tuple[str, ...] = tuple(MARKERS), line: str = "line") -> DataFrame:
    """The columns of ``lines`` with ``stack`` and ``kind``, a row for each marker of the stacks that a line has."""
    rules = [Rule(kind, stack, pattern, needles) for stack in stacks for kind, pattern, needles in MARKERS[stack]]
    return scan_rules(lines, rules, line).withColumnsRenamed({"rule": "kind", "family": "stack"})
