"""Knowledge table: what a finding type means, which CVEs go with it, what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import broadcast_if_small

DEFAULT_TYPE = "Unknown"

SCHEMA = (
    "type string, description string, mitre string, "
    "cves array<struct<id: string, summary: string, cvss: double>>, mitigations array<string>"
)

# The knowledge table, as (type, description, mitre, cves, mitigations).
KNOWLEDGE = [
    (
        "Port Scan",
        "Port scanning probes a host or network to discover open services. It is typically the reconnaissance phase of a multi-stage attack.",
        "T1046 — Network Service Discovery",
        [
            ("CVE-2021-44228", "Log4Shell — exploited after port 8080/8443 enumeration reveals Log4j-backed services.", 10.0),
            ("CVE-2022-0847", "Dirty Pipe — local privilege escalation after SSH (port 22) is reached via scan.", 7.8),
        ],
        [
            "Block unsolicited inbound SYN packets at the perimeter firewall.",
            "Enable port-scan detection on IDS (Snort rule sid:1000001).",
            "Restrict internal host-to-host port enumeration with micro-segmentation.",
        ],
    ),
    (
        "Brute Force",
        "Repeated failed authentication attempts against a single port, typically SSH (22), RDP (3389), or HTTP (80/443).",
        "T1110 — Brute Force",
        [
            ("CVE-2023-38408", "OpenSSH remote code execution — brute-forced credential access enables exploit delivery.", 9.8),
            ("CVE-2019-0708", "BlueKeep RDP — attackers brute-force weak RDP credentials then pivot with BlueKeep.", 9.8),
        ],
        [
            "Enforce account lockout after 5 failed attempts.",
            "Deploy fail2ban or equivalent on all internet-facing services.",
            "Require MFA for SSH and RDP; disable password authentication where possible.",
            "Rate-limit inbound connections per source IP at the firewall.",
        ],
    ),
    (
        "Traffic Spike",
        "A sudden, sustained surge in inbound traffic volume — characteristic of volumetric DDoS or data flood attacks.",
        "T1498 — Network Denial of Service",
        [
            ("CVE-2022-26143", "TP-240 amplification DDoS — reflector exploited to produce >4 billion:1 amplification ratio.", 8.6),
            ("CVE-2021-3156", "Sudo heap overflow — exploited post-DDoS once legitimate traffic is disrupted.", 7.8),
        ],
        [
            "Enable rate-limiting and traffic shaping at the upstream edge.",
            "Activate scrubbing centre / CDN DDoS protection (e.g., Cloudflare Magic Transit).",
            "Alert on traffic volume exceeding 3× 15-minute baseline.",
            "Validate source IPs with BCP-38 anti-spoofing filters.",
        ],
    ),
    (
        "Data Exfiltration",
        "Sustained high-volume outbound transfers from a single internal host — consistent with an attacker staging and transferring sensitive data.",
        "T1048 — Exfiltration Over Alternative Protocol",
        [
            ("CVE-2023-0669", "GoAnywhere MFT RCE — used in Cl0p ransomware campaign that exfiltrated 130+ organisations.", 7.2),
            ("CVE-2021-26855", "ProxyLogon (Exchange) — gave attackers mailbox access enabling large-scale email exfiltration.", 9.8),
        ],
        [
            "Enforce egress filtering — alert on outbound transfers >500 MB from a single host.",
            "Enable DLP rules on the network boundary.",
            "Inspect and log DNS queries for long or encoded subdomains (DNS tunnelling).",
            "Segment high-value data stores and require explicit egress approval.",
        ],
    ),
    (
        "Night Activity",
        "Significant connection volume occurring during off-hours (00:00–05:59). Often indicates automated/scripted attacker activity or compromised host beaconing.",
        "T1029 — Scheduled Transfer",
        [
            ("CVE-2020-1472", "Zerologon — exploited in off-hours DC attacks by ransomware operators to reset machine passwords.", 10.0),
            ("CVE-2021-34527", "PrintNightmare — privilege escalation used in overnight lateral movement campaigns.", 8.8),
        ],
        [
            "Alert on any outbound connection from servers during 00:00–05:59 outside of maintenance windows.",
            "Implement time-of-day access controls for privileged accounts.",
            "Require change-management approval for overnight batch jobs.",
        ],
    ),
    (
        "Botnet C&C",
        "Long idle flows with low packet rate and irregular timing — hallmarks of botnet command-and-control beacon traffic.",
        "T1071 — Application Layer Protocol C2",
        [
            ("CVE-2021-44228", "Log4Shell — widely used in Mirai/Muhstik botnet initial access campaigns.", 10.0),
            ("CVE-2017-0144", "EternalBlue (SMB) — Mirai and subsequent botnets exploited this for rapid propagation.", 9.3),
        ],
        [
            "Block known C&C IP ranges using threat intelligence feeds (e.g., Abuse.ch).",
            "Inspect long-duration low-bandwidth flows — typical C&C beacon signature.",
            "Enable DNS RPZ (Response Policy Zone) to sinkhole known botnet domains.",
            "Hunt for processes making outbound connections on unusual ports.",
        ],
    ),
    (
        "Unknown",
        "The Isolation Forest flagged this window as anomalous but no specific attack pattern matched the rule-based classifier. Manual review recommended.",
        "T1040 — Network Sniffing (investigate further)",
        [],
        [
            "Capture a full PCAP of the flagged window for manual inspection.",
            "Cross-reference source IP against threat intelligence (VirusTotal, Shodan).",
            "Review host logs for the flagged source IP at the anomaly timestamp.",
        ],
    ),
]


def knowledge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWLEDGE, SCHEMA)


def enrich(findings: DataFrame, knowledge: DataFrame | None = None, column: str = "type") -> DataFrame:
    """Add ``entry``, ``description``, ``mitre``, ``cves`` and ``mitigations`` for each row's type.

    Types without an entry get the default one. The built-in table has a fixed handful of rows and
    is broadcast, and so is a table given by the caller if it is found to be small. A large one should
    not be joined to findings that are mostly of one type: :func:`enrich_types` has a row per type.
    """
    if knowledge is None:
        knowledge = F.broadcast(knowledge_table(findings.sparkSession))
    else:
        knowledge = broadcast_if_small(knowledge)
    fields = [c for c in knowledge.columns if c != "type"]
    entries = knowledge.select(
        F.col("type").alias("_entry"), F.struct(*fields).alias("_known")
    )
    default = F.broadcast(
        knowledge.filter(F.col("type") == DEFAULT_TYPE).agg(
            F.first(F.struct(*fields)).alias("_default")
        )
    )
    joined = findings.join(entries, F.col(column) == F.col("_entry"), "left").join(
        default, F.lit(True), "left"
    )
    chosen = F.coalesce("_known", "_default")
    return joined.select(
        *findings.columns,
        F.coalesce("_entry", F.lit(DEFAULT_TYPE)).alias("entry"),
        *[chosen[f].alias(f) for f in fields],
    )


def enrich_types(findings: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """Each distinct type once, with its knowledge entry."""
    return enrich(findings.select("type").distinct(), knowledge)


def type_cves(findings: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """One row per distinct type and CVE; types without CVEs keep one row."""
    found = enrich_types(findings, knowledge)
    return found.select(
        "type", "entry", "mitre", F.posexplode_outer("cves").alias("_pos", "cve")
    ).select(
        "type", "entry", "mitre", (F.col("_pos") + 1).alias("cve_rank"),
        F.col("cve.id").alias("cve_id"), F.col("cve.summary").alias("summary"),
        F.col("cve.cvss").alias("cvss"),
    )


def type_mitigations(findings: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """One row per distinct type and mitigation, numbered."""
    found = enrich_types(findings, knowledge)
    return found.select("type", F.posexplode("mitigations").alias("_pos", "mitigation")).select(
        "type", (F.col("_pos") + 1).alias("step"), "mitigation"
    )
