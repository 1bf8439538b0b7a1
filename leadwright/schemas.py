"""Fixed schemas of the tables, as Spark DDL; `long` identifiers, timestamps without zone in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Table layouts.
TABLES: dict[str, str] = {
    "domains": "id long, category_code string, category_title string, state string, org_type string, org_type_title string, title string, main_url string, contact_url string, external_id string, imported_at timestamp_ntz",
    "crawl_snapshots": "id long, job_id long, source_domain_id long, external_id string, category_code string, category_title string, state string, org_type string, org_type_title string, title string, main_url string, contact_url string, is_seed boolean, created_at timestamp_ntz",
    "crawl_jobs": "id long, category_filter string, title_filter string, domain_ids string, source_type string, status string, total_domains int, crawled_domains int, seed_domains int, queued_urls int, visited_urls int, skipped_urls int, leads_found int, current_depth int, active_workers int, error_message string, owner_id long, cancel_requested boolean, agent_hostname string, last_heartbeat_at timestamp_ntz, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz",
    "crawl_job_domains": "job_id long, domain_id long",
    "job_custom_urls": "id long, job_id long, url string, created_at timestamp_ntz",
    "leads": "id long, job_id long, snapshot_id long, email string, person_name string, designation string, department string, source_url string, source_title string, context_snippet string, manual_state string, entity_kind string, phone string, channel_tag string, confidence_band string, field_provenance string, lead_score int, depth int, captured_at timestamp_ntz",
    "lead_occurrences": "id long, lead_id long, job_id long, captured_by long, source_url string, captured_at timestamp_ntz",
    "captures": "seq long, job_id long, snapshot_id long, email string, person_name string, designation string, department string, source_url string, source_title string, context_snippet string, entity_kind string, phone string, channel_tag string, confidence_band string, field_provenance string, depth int, captured_by long",
    "email_templates": "id long, name string, subject string, raw_body string",
    "campaigns": "id long, name string, template_id long, kind string, test_credential_id long, status string, owner_id long, created_at timestamp_ntz, pause_reason string",
    "smtp_credentials": "id long, host string, port int, username string, is_active boolean, cooldown_until timestamp_ntz, daily_send_limit int, provider string",
    "campaign_credentials": "id long, campaign_id long, credential_id long",
    "campaign_emails": "id long, campaign_id long, lead_id long, recipient_email string, subject string, body string, status string, is_selected boolean, missing_fields string, error_message string, sent_at timestamp_ntz, sending_since timestamp_ntz, credential_id long",
    "blacklist": "id long, email string, domain string, reason string",
    "roles": "id long, name string, description string, is_system boolean",
    "permissions": "key string, description string",
    "users": "id long, email string, full_name string, is_admin boolean, is_active boolean, role_id long, token_version int, failed_logins int, locked_until timestamp_ntz, created_at timestamp_ntz",
    "role_permissions": "role_id long, permission_key string",
    "user_permissions": "user_id long, permission_key string, effect string",
    "user_sessions": "id long, user_id long, token_hash string, expires_at timestamp_ntz, revoked_at timestamp_ntz, user_agent string, ip string, created_at timestamp_ntz",
    "audit_log": "id long, user_id long, action string, target_type string, target_id string, detail string, ip string, created_at timestamp_ntz",
    "outbox": "id long, job_id long, kind string, payload_json string, attempts int, last_error string, created_at double",
    "visited_history": "url string, visited_at double",
}

JOB_STATES = ("pending", "running", "interrupted", "done", "failed", "cancelled")
TERMINAL_JOB_STATES = ("done", "failed", "cancelled")
EMAIL_STATES = ("DRAFT", "QUEUED", "SENDING", "SENT", "FAILED")
CAMPAIGN_STATES = ("PAUSED", "RUNNING", "COMPLETED", "CANCELLED")


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in their order and types; missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))


def with_ids(df: DataFrame, order: list, start: int = 0) -> DataFrame:
    """Surrogate keys in the given order, following `start`. For tables of one row an entity (roles, jobs, campaigns): the order is global."""
    from pyspark.sql import Window

    return df.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + start).cast("long"))
