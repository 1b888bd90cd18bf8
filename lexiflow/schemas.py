"""Fixed schemas of the two record families and the named feature sets."""

from pyspark.sql import types as T

# Review record, newline-delimited JSON.
REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.IntegerType()),
    T.StructField("useful", T.IntegerType()),
    T.StructField("funny", T.IntegerType()),
    T.StructField("cool", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()),
])

# Per-field defaults used when a decoded review lacks a field.
REVIEW_DEFAULTS = {"review_id": "", "user_id": "", "business_id": "", "stars": 0,
                   "useful": 0, "funny": 0, "cool": 0, "text": "", "date": ""}

REVIEW_TARGETS = ["stars", "useful", "funny", "cool"]

# Flow-record column names in file order (47 features, then the
# two targets).  One name contains a blank, as in the source data.
FLOW_FEATURES = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes",
    "sttl", "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts",
    "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len",
    "Sjit", "Djit", "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat",
    "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd",
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ ltm", "ct_src_dport_ltm",
    "ct_dst_sport_ltm", "ct_dst_src_ltm",
]
FLOW_TARGETS = ["attack_cat", "Label"]

_STRING = {"srcip", "sport", "dstip", "dsport", "proto", "state", "service",
           "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "is_sm_ips_ports", "attack_cat",
           "Label"}
_DOUBLE = {"dur", "Sload", "Dload", "Sjit", "Djit", "Sintpkt", "Dintpkt", "tcprtt",
           "synack", "ackdat"}


def _flow_type(name):
    if name in _STRING:
        return T.StringType()
    if name in _DOUBLE:
        return T.DoubleType()
    return T.LongType()


# Read everything that may be dirty as string; clean-up casts with clean.try_to.
FLOW = T.StructType([T.StructField(c, _flow_type(c)) for c in FLOW_FEATURES + FLOW_TARGETS])

# Category canonicalisation (raw value -> cleaned value).
FLOW_CLASS_ALIASES = {"Backdoor": "Backdoors", " Fuzzers ": "Fuzzers", " Fuzzers": "Fuzzers",
                      " Reconnaissance ": "Reconnaissance", " Shellcode ": "Shellcode"}

# Named feature subsets used by the model families.
FEATURE_SETS = {
    "all47": list(FLOW_FEATURES),
    "feat20": ["sport", "dsport", "proto", "state", "sbytes", "dbytes", "sttl", "dttl",
               "service", "Sload", "Dload", "Dpkts", "smeansz", "dmeansz", "tcprtt", "ackdat",
               "ct_state_ttl", "ct_srv_src", "ct_srv_dst", "ct_src_dport_ltm"],
    "feat15": ["sport", "dsport", "proto", "sbytes", "dbytes", "sttl", "dttl", "service",
               "Sload", "Dload", "Dpkts", "smeansz", "dmeansz", "ct_state_ttl", "ct_srv_dst"],
    "feat10": ["sport", "dsport", "sbytes", "sttl", "dttl", "service", "Dload", "smeansz",
               "dmeansz", "ct_state_ttl"],
    "feat5": ["sport", "dsport", "sbytes", "sttl", "ct_state_ttl"],
    "rf_correlated": ["sttl", "ct_state_ttl", "dttl", "ackdat", "state", "tcprtt"],
    "rf_important": ["proto", "dsport", "ct_srv_dst", "dbytes", "sbytes", "dmeansz",
                     "smeansz", "sport", "Dpkts"],
    "rf_categorical": ["srcip", "dstip"],
}
# The analysis set (18 columns).
FEATURE_SETS["analysis18"] = [
    "dur", "sbytes", "smeansz", "trans_depth", "Sjit", "dstip", "service", "Sload", "Stime", "Ltime", "synack",
    "proto", "tcprtt", "state", "ackdat", "dttl", "ct_state_ttl", "sttl"]
# The forest family uses correlated + important + categorical (17 columns).
FEATURE_SETS["rf17"] = (FEATURE_SETS["rf_correlated"] + FEATURE_SETS["rf_important"]
                        + FEATURE_SETS["rf_categorical"])
