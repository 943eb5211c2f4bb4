"""Schemas of the evidence tables. Lists are arrays and maps, not JSON in text; no schema is inferred."""

from __future__ import annotations

TABLES = {
    "shops": "id long, url string, domain string, name string, risk_score double, risk_level string, added_by long, created_at timestamp",
    "scans": "id long, shop_id long, user_id long, status string, started_at timestamp, completed_at timestamp, collectors_requested array<string>, collectors_completed array<string>, error_message string",
    "whois": "id long, shop_id long, scan_id long, registrar string, registration_date date, expiration_date date, domain_age_days int, registrant_country string, name_servers array<string>, is_privacy_protected boolean, raw_data string, collected_at timestamp",
    "ssl": "id long, shop_id long, scan_id long, has_ssl boolean, issuer string, subject string, valid_from timestamp, valid_until timestamp, is_expired boolean, is_self_signed boolean, san_domains array<string>, collected_at timestamp",
    "scrape": "id long, shop_id long, scan_id long, source_url string, emails array<string>, phones array<string>, addresses array<string>, kvk array<string>, btw array<string>, iban array<string>, social map<string,string>, external_links array<string>, has_contact boolean, has_privacy boolean, has_terms boolean, has_return boolean, is_opening_soon boolean, is_maintenance boolean, has_delivery_time boolean, has_preorder boolean, has_whatsapp boolean, has_suspicious_prices boolean, languages array<string>, sources map<string,array<string>>, collected_at timestamp",
    "kvk": "id long, shop_id long, scan_id long, kvk_number string, company_name string, trade_names array<string>, legal_form string, street string, house_number string, postal_code string, city string, is_active boolean, sbi_codes array<string>, collected_at timestamp",
    "dns_http": "id long, shop_id long, scan_id long, a_records array<string>, mx_records array<string>, txt_records array<string>, ns_records array<string>, has_spf boolean, has_dmarc boolean, has_mx boolean, security_score int, redirects array<struct<url:string,status_code:int,location:string>>, collected_at timestamp",
    "tech": "id long, shop_id long, scan_id long, technologies map<string,array<string>>, ecommerce_platform string, cms string, payment_providers array<string>, collected_at timestamp",
    "trustmark": "id long, shop_id long, scan_id long, verifications array<struct<name:string,status:string,claimed:boolean,verified:boolean>>, total_verified int, claimed_not_verified int, trustpilot_score double, collected_at timestamp",
    "ad_tracker": "id long, shop_id long, scan_id long, trackers array<struct<platform:string,id:string,display_id:string>>, cross_references array<struct<id:string,shop_id:bigint>>, collected_at timestamp",
    "scam": "id long, shop_id long, scan_id long, flagged boolean, total_hits int, checks array<struct<source:string,found:boolean,count:int,hits:array<string>>>, collected_at timestamp",
    "bag_validation": "id long, shop_id long, scan_id long, addresses_checked int, addresses_valid int, addresses_invalid int, results array<struct<address:string,valid:boolean,score:double>>, collected_at timestamp",
    "status_check": "id long, shop_id long, is_online boolean, http_status_code int, response_time_ms int, error_message string, checked_at timestamp",
    "pages": "shop_id long, url string, status_code int, headers map<string,string>, html string, redirects array<struct<url:string,status_code:int,location:string>>, fetched_at timestamp",
}


def empty(spark, name: str):
    return spark.createDataFrame([], TABLES[name])


def read(spark, folder: str, name: str):
    """An evidence table, written as Parquet under its name."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
