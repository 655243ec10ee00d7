"""Event vocabularies."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed values.
CATEGORIES = tuple(
    "firewall ids alert web malware auth dns mail dlp vpn application endpoint network data tamper vuln utm posture exec secrets account recon"
    " postscreen reject mailflow mail-phishing mail-url health config audit system update container k8s ebpf ban integrity syslog inventory trace".split()
)
CORE_FIELDS = tuple("ts source category severity message host src_ip dst_ip url dedup fields engagement_id origin env_id".split())
ACTIONS = tuple("success failure allowed blocked ban read modify delete sudo session_open session_close".split())
FRAMEWORKS = tuple("pci_dss hipaa nist_800_53 gdpr tsc iso_27001 cis".split())


def category_ok(text: str) -> bool:
    return text in CATEGORIES


def framework_ok(text: str) -> bool:
    return text in FRAMEWORKS


def known_category(c: Column) -> Column:
    return c.isin(*CATEGORIES)
