"""The projected transaction columns, their types and what is required of them.

Fixed values of the input contract, in the order of the download.
"""

PROJECTED = (
    "contract_transaction_unique_key", "contract_award_unique_key", "action_date", "federal_action_obligation",
    "modification_number", "transaction_number", "action_type_code", "action_type", "transaction_description",
    "award_id_piid", "award_type_code", "recipient_uei", "recipient_name", "recipient_parent_uei",
    "awarding_agency_code", "awarding_agency_name", "awarding_sub_agency_code", "awarding_sub_agency_name",
    "awarding_office_code", "awarding_office_name", "funding_agency_code", "funding_agency_name",
    "funding_sub_agency_code", "funding_sub_agency_name", "funding_office_code", "funding_office_name",
    "parent_award_id_piid", "parent_award_agency_id", "parent_award_type_code", "parent_award_type",
    "naics_code", "naics_description", "product_or_service_code", "product_or_service_code_description",
    "prime_award_base_transaction_description", "usaspending_permalink", "period_of_performance_start_date",
    "period_of_performance_current_end_date", "total_dollars_obligated", "current_total_value_of_award",
    "potential_total_value_of_award", "recipient_country_code", "recipient_state_code",
    "prime_award_transaction_recipient_county_fips_code", "recipient_city_name", "recipient_zip_4_code",
    "primary_place_of_performance_country_code", "primary_place_of_performance_state_code",
    "prime_award_transaction_place_of_performance_county_fips_code", "primary_place_of_performance_city_name",
    "primary_place_of_performance_zip_4",
)

REQUIRED = ("contract_transaction_unique_key", "contract_award_unique_key", "action_date")
DATES = ("action_date", "period_of_performance_start_date", "period_of_performance_current_end_date")
MONEY = ("federal_action_obligation", "total_dollars_obligated", "current_total_value_of_award", "potential_total_value_of_award")
