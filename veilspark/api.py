"""The public names in one place."""

from .errors import *  # noqa: F403
from .operators.audit import append as append_audit, entries as audit_entries, from_json as audit_from_json, render as render_audit, save_json as save_audit_json, summary as audit_summary
from .operators.compliance import Report as ComplianceReport, identifiers, report as compliance_report, save_json, to_markdown
from .operators.deidentify import Config as SafeHarborConfig, deidentify, ensure_salt
from .operators.kanonymity import Rule, check as check_k_anonymity, check_diversity, classes, enforce as enforce_k_anonymity, generalise, violations
from .operators.ledger import Ledger
from .operators.lineage import ancestors, history, labels as lineage_labels, linked, node, parents, to_dict as lineage_dict, trace, trace_all
from .operators.pipeline import PipelineConfig, PipelineResult, ingest, run as run_pipeline
from .operators.private_stats import Budget as PrivacyBudget, Count, Gaussian, Histogram, Laplace, Mean, Result as DPResult, private_stats, release
from .operators.synthesis import Risk, Utility, evaluate as evaluate_utility, sample, synthesize, validate as validate_risk
from .operators.verify import findings, verifier
from .schema import RESOURCE_TYPES, conditions, encounters, merge, observations, of_type, patients, read_json, to_dicts, write_json
from .sources.documents import read_documents
from .sources.fhir import Auth as FHIRAuth, FHIRSource, read_bundles
from .sources.hl7 import read_hl7
from .sources.tables import read_csv
