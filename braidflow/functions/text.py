"""Column functions on text: entropy, ratios, token counts, code maps, features of names and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of injection, scripting, traversal and command use in a request; any letter case counts.
SUSPICIOUS = (
    r"(?i)(union\s+select|select\s+.+from|or\s+1=1|--\s|/\*|<script|onerror\s*=|onload\s*=|alert\(|javascript:|\.\./|/etc/passwd|/etc/shadow|"
    r";\s*(rm|wget|curl|nc|bash|sh)\s|exec\(|system\(|\|\|\s*\w+|`[^`]+`)"
)
#: The characters that count as special in a request.
SPECIAL = "'\";<>()%\\|&="
#: Codes by name, and the code of any other name.
METHODS, OTHER_METHOD = {"GET": 0, "POST": 1, "PUT": 2, "DELETE": 3, "HEAD": 4}, 5
QUERY_TYPES, OTHER_QUERY_TYPE = {"A": 0, "AAAA": 1, "TXT": 2, "CNAME": 3, "MX": 4, "NS": 5, "SOA": 6, "PTR": 7, "SRV": 8}, 9
RESPONSE_CODES, OTHER_RESPONSE_CODE = {"NOERROR": 0, "NXDOMAIN": 1, "SERVFAIL": 2, "REFUSED": 3}, 4
CONN_STATES, OTHER_CONN_STATE = {"SF": 0, "S0": 1, "REJ": 2, "S1": 3, "S2": 4, "S3": 5, "RSTO": 6, "RSTR": 7, "RSTOS0": 8, "RSTRH": 9, "SH": 10, "SHR": 11, "OTH": 12}, 12
#: How a log writes an absent field.
ABSENT = ("-", "(empty)")


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty or null."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    term = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - term(c) * F.log2(term(c)))
    return F.coalesce(F.when(F.length(s) > 0, total), F.lit(0.0))


def ratio_of(s: Column, pattern: str) -> Column:
    """Share of the characters that match; 0 for empty or null."""
    return F.coalesce(F.when(F.length(s) > 0, F.regexp_count(s, F.lit(pattern)) / F.length(s)), F.lit(0.0))


def special_ratio(s: Column) -> Column:
    """Share of the characters of :data:`SPECIAL`."""
    kept = F.translate(s, SPECIAL, "")
    return F.coalesce(F.when(F.length(s) > 0, (F.length(s) - F.length(kept)) / F.length(s)), F.lit(0.0))


def non_alnum_ratio(s: Column) -> Column:
    return ratio_of(s, "[^A-Za-z0-9]")


def suspicious_count(s: Column) -> Column:
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(SUSPICIOUS)).cast("long")


def code_of(value: Column, codes: dict[str, int], default: int = -1) -> Column:
    table = F.create_map(*[F.lit(x) for item in codes.items() for x in item])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def method_code(name: Column) -> Column:
    return code_of(F.upper(name), METHODS, OTHER_METHOD)


def query_type_code(name: Column) -> Column:
    return code_of(F.upper(name), QUERY_TYPES, OTHER_QUERY_TYPE)


def response_code(name: Column) -> Column:
    return code_of(F.upper(name), RESPONSE_CODES, OTHER_RESPONSE_CODE)


def conn_state_code(name: Column) -> Column:
    """States are told by exact name."""
    return code_of(name, CONN_STATES, OTHER_CONN_STATE)


def field(value: Column, default: str = "") -> Column:
    """A log's text field; ``default`` where it is absent."""
    return F.when(value.isNull() | value.isin(*ABSENT), default).otherwise(value)


def number(value: Column, default: float = 0.0) -> Column:
    """A log's numeric field; ``default`` where it is absent or no number."""
    return F.coalesce(F.when(~value.cast("string").isin(*ABSENT), value.try_cast("double")), F.lit(default))


def dns_features(query: Column, qtype: Column, rcode: Column, answers: Column) -> dict[str, Column]:
    """Eight features of a name query, in their order; ``answers`` is a comma-joined list."""
    q, a = field(query), field(answers)
    return {
        "query_len": F.length(q),
        "query_entropy": entropy(q),
        "subdomain_count": F.when(q != "", F.regexp_count(q, F.lit(r"\.")) + 1).otherwise(0),
        "qtype_enc": query_type_code(field(qtype, "A")),
        "rcode_enc": response_code(field(rcode, "NOERROR")),
        "answer_count": F.when(a != "", F.regexp_count(a, F.lit(",")) + 1).otherwise(0),
        "resp_size": F.length(a),
        "query_special_ratio": non_alnum_ratio(q),
    }


def http_features(method: Column, uri: Column, host: Column, agent: Column, referrer: Column, status: Column, request_bytes: Column, response_bytes: Column) -> dict[str, Column]:
    """Eleven features of a request, in their order."""
    u, ua = field(uri, "/"), field(agent)
    present = lambda c: F.when(field(c) != "", 1.0).otherwise(0.0)
    return {
        "uri_len": F.length(u),
        "uri_special_ratio": special_ratio(u),
        "uri_token_hits": suspicious_count(u),
        "method_enc": method_code(field(method, "GET")),
        "status_code": number(status),
        "req_body_len": number(request_bytes),
        "resp_body_len": number(response_bytes),
        "ua_len": F.length(ua),
        "ua_entropy": entropy(ua),
        "host_present": present(host),
        "referrer_present": present(referrer),
    }


def conn_features(duration: Column, orig_bytes: Column, resp_bytes: Column, orig_pkts: Column, resp_pkts: Column, state: Column, same_port: Column, same_service: Column) -> dict[str, Column]:
    """Twelve session features of a connection record and its origin code, in their order.

    ``same_port`` and ``same_service`` are the destination's recent connections (see ``windows.sliding_count``). The log
    has no times to live; its origin counts as 1.
    """
    d, ob, rb = number(duration), number(orig_bytes), number(resp_bytes)
    seconds = F.greatest(d, F.lit(1e-9))
    return {
        "flow_dur_us": d * 1e6, "fwd_bytes": ob, "bwd_bytes": rb, "fwd_pkts": number(orig_pkts), "bwd_pkts": number(resp_pkts), "src_ttl": F.lit(0.0), "dst_ttl": F.lit(0.0),
        "sload": ob * 8 / seconds, "dload": rb * 8 / seconds, "state_enc": conn_state_code(F.coalesce(state, F.lit("OTH"))), "ct_dst_sport_ltm": same_port, "ct_srv_dst": same_service, "src": F.lit(1),
    }
