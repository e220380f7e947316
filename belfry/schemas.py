"""Column contracts of the tables and nested documents, as DDL text."""

from __future__ import annotations

PARISH = ("id bigint, slug string, name string, homepage_url string, bulletin_provider string, "
             "provider_id string, created_at string")
CHURCH = ("id bigint, parish_id bigint, slug string, name string, address_line1 string, "
             "address_line2 string, city string, state string, postal_code string, latitude double, "
             "longitude double, name_verified int, address_verified int, created_at string")
BULLETIN = ("id bigint, parish_id bigint, source_url string, pdf_path string, published_date string, "
               "fetched_at string, processed_at string, content_hash string")
EVENT = ("id bigint, church_id bigint, bulletin_id bigint, event_type string, event_kind string, "
            "day_of_week string, date string, start_time int, end_time int, cancelled int, "
            "page_number int, note string")
METADATA = ("idx bigint, parish_slug string, source_url string, pdf_path string, content_hash string, "
               "fetched_at string, processed_at string, published_date string")
RAW_EVENT = ("church_slug string, bulletin_source_url string, event_type string, event_kind string, "
                "day_of_week string, date string, start_time string, end_time string, cancelled boolean, "
                "page_number int, note string")
EXTRACTED_EVENT = ("struct<church_slug:string,type:string,kind:string,day_of_week:string,date:string,"
                   "start_time:string,end_time:string,cancelled:boolean,page_number:int,note:string>")
RESULT = (f"struct<events:array<{EXTRACTED_EVENT}>,church_list_needs_review:boolean,"
          "published_date:string,wrong_bulletin:boolean>")
ADDRESS = "struct<line1:string,line2:string,city:string,state:string,postal_code:string>"
VERDICT = (f"struct<church_slug:string,name_status:string,address_status:string,corrected_name:string,"
           f"corrected_address:{ADDRESS},slug_needs_review:boolean>")
NEW_CHURCH = f"struct<name:string,slug:string,address:{ADDRESS}>"
VERIFICATION = f"struct<existing_churches:array<{VERDICT}>,new_churches:array<{NEW_CHURCH}>>"
GEOCODE = ("idx bigint, line1 string, line2 string, city string, state string, postal_code string, "
              "latitude double, longitude double")

# File column orders and required headers.
PARISH_CSV = ["slug", "name", "website", "bulletin_provider", "provider_id"]
CHURCH_CSV = ["parish_id", "slug", "name", "line1", "line2", "city", "state", "postal_code",
              "name_verified", "address_verified", "latitude", "longitude"]
PARISH_CSV_REQUIRED = ["slug", "name", "website"]
CHURCH_CSV_REQUIRED = ["parish_id", "slug", "name", "line1", "city", "state", "postal_code"]

# Enumerations.
EVENT_TYPES = ["mass", "confession", "adoration"]
VERDICTS = ["verified", "incorrect", "unverifiable"]
PROVIDERS = ["ecatholic", "parishes_online", "discover_mass", "other"]
