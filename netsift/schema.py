"""Schemas and fixed tables of the flow data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical flow columns, in canonical order.
FLOW_COLUMNS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl",
    "dttl", "sloss", "dloss", "service", "sload", "dload", "spkts", "dpkts", "swin", "dwin",
    "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "sjit", "djit", "stime",
    "ltime", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat", "is_sm_ips_ports", "ct_state_ttl",
    "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm",
    "ct_src__ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
]

TEXT_COLUMNS = ["srcip", "dstip", "proto", "state", "service"]
DRIFT_CATEGORICAL = ["proto", "state", "service"]
REAL_COLUMNS = [
    "dur", "sload", "dload", "smeansz", "dmeansz", "sjit", "djit", "stime", "ltime", "sintpkt",
    "dintpkt", "tcprtt", "synack", "ackdat",
]
LABEL_COLUMNS = ["label", "attack_cat", "target"]


def _flow_type(name: str) -> T.DataType:
    if name in TEXT_COLUMNS:
        return T.StringType()
    return T.DoubleType() if name in REAL_COLUMNS else T.LongType()


FLOW_SCHEMA = T.StructType([T.StructField(c, _flow_type(c)) for c in FLOW_COLUMNS])
LABELLED_FLOW_SCHEMA = T.StructType(
    FLOW_SCHEMA.fields + [T.StructField("attack_cat", T.StringType()), T.StructField("label", T.IntegerType())]
)

PACKET_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("seq_no", T.LongType()),
    T.StructField("srcip", T.StringType()),
    T.StructField("sport", T.LongType()),
    T.StructField("dstip", T.StringType()),
    T.StructField("dsport", T.LongType()),
    T.StructField("proto", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("ttl", T.LongType()),
    T.StructField("flags", T.LongType()),
    T.StructField("window", T.LongType()),
    T.StructField("tcp_seq", T.LongType()),
    T.StructField("payload", T.StringType()),
])

# Destination port to service name.
PORT_SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http",
    110: "pop3", 123: "ntp", 143: "imap", 443: "https", 445: "smb", 465: "smtp", 587: "smtp",
    993: "imap", 995: "pop3", 3306: "mysql", 3389: "rdp", 8080: "http",
}

# Spelling variants of attack categories.
CATEGORY_VARIANTS = {
    "Backdoors": "Backdoor",
    "backdoor": "Backdoor",
    "backdoors": "Backdoor",
    "exploits": "Exploits",
    "dos": "DoS",
    "reconnaissance": "Reconnaissance",
    "fuzzers": "Fuzzers",
    "shellcode": "Shellcode",
    "worms": "Worms",
    "analysis": "Analysis",
    "generic": "Generic",
}

# Class-size rules of the training set.
RARE_CLASS_MIN = 9_000
CLASS_CAPS = {"Normal": 50_000, "Generic": 40_000, "Exploits": 30_000}

# Request prefixes that count as an HTTP method, and FTP login verbs.
HTTP_METHODS = ["GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS ", "PATCH "]
FTP_LOGIN_VERBS = ["USER", "PASS"]

# Fields checked on scoring records, in check order.
VALIDATED_FIELDS = [
    "proto", "service", "state", "sport", "dsport", "dur", "sbytes", "dbytes", "sttl", "dttl",
    "sloss", "sload", "dload", "spkts", "dwin", "stcpb", "dtcpb", "swin", "smeansz", "dmeansz",
    "trans_depth", "res_bdy_len", "sjit", "djit", "stime", "sintpkt", "dintpkt", "tcprtt",
    "synack", "ackdat", "is_sm_ips_ports", "ct_state_ttl", "ct_ftp_cmd", "ct_srv_src",
    "ct_srv_dst", "ct_dst_ltm", "ct_src__ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm",
]
SIGNED_FIELDS = ["stime", "stcpb", "dtcpb"]

# Defaults of scoring records that differ from zero.
RECORD_DEFAULTS = {
    "proto": "tcp", "service": "http", "state": "est", "sttl": 64.0, "dttl": 64.0,
    "sbytes": 500.0, "dbytes": 1000.0, "dwin": 8192.0,
}

# Watched domains in match order, with the scenario each belongs to.
WATCH_DOMAINS = [
    ("testphp.vulnweb.com", "exploits"),
    ("vulnweb.com", "exploits"),
    ("ddostest.me", "dos"),
    ("scanme.nmap.org", "recon"),
    ("nmap.org", "recon"),
    ("hackthissite.org", "generic"),
    ("www.hackthissite.org", "generic"),
    ("webscantest.com", "fuzzers"),
    ("www.webscantest.com", "fuzzers"),
]

# Scenario key, label, source domain, description, hint, duration in seconds.
SCENARIOS = [
    ("exploits", "Exploits", "testphp.vulnweb.com",
     "SQL injection / buffer overflow payload detected",
     "CVE pattern: remote code execution via HTTP", 45),
    ("dos", "DoS", "ddostest.me",
     "Denial-of-Service SYN-flood pattern detected",
     "High packet rate, abnormal SYN/ACK ratio", 30),
    ("recon", "Reconnaissance", "scanme.nmap.org",
     "Port scan / network fingerprinting detected",
     "Sequential port probing, low-TTL probes", 40),
    ("generic", "Generic", "hackthissite.org",
     "Generic malicious payload pattern detected",
     "Anomalous payload size and inter-packet timing", 35),
    ("fuzzers", "Fuzzers", "www.webscantest.com",
     "Fuzzing / parameter tampering pattern detected",
     "Randomised input injection across multiple endpoints", 30),
]

# Drift severity defaults (low, moderate, severe) and the F1 quality steps.
SEVERITY_DEFAULTS = (0.20, 0.40, 0.60)
QUALITY_STEPS = [(0.85, "GOOD"), (0.70, "OK"), (0.50, "WEAK")]

# Columns a derived feature is computed from.
DERIVED_SOURCES = {
    "duration": ["stime", "ltime"],
    "packet_rate": ["dpkts", "stime", "ltime"],
    "byte_ratio": ["sbytes", "dbytes"],
}
