"""Domain parameters: what a code, a company, a keyword or a template is.

Every operator takes a `Domain`, so another corpus needs another instance and
no other code. The defaults describe Russian insurance guarantee letters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- Fixed values: these decide results and must stay as they are -----------

CODE_PATTERN = r"F\d{2}\.\d{2}\.\d{2}\.\d\.\d{3}"
DIAGNOSIS_PATTERN = r"[A-Z]\d{2}\.?\d*"

COMPANY_PATTERNS = (
    ("Согаз", "Согаз|СОГАЗ"),
    ("Ингосстрах", "Ингосстрах|ИНГОССТРАХ"),
)
OTHER_COMPANY = "Другая"

CLASS_0_PHRASES = (
    "необходимые исследования",
    "необходимые лабораторные",
    "в рамках программы ДМС",
    "в рамках стандартной программы",
    "организовать приемы врача",
    "манипуляции в рамках",
    "согласно программе",
    "предусмотренной договором",
)
CLASS_1_PHRASES = (
    "оплата будет осуществляться",
    "диагноз",
    "код МКБ",
    "результатам экспертизы",
    "медицинской документации",
)

# Substrings of the handcrafted classifier features (lower case).
FEATURE_COMPANIES = ("согаз", "ингосстрах")
FEATURE_CLASS_0 = ("необходимые исследования", "приемы врача", "консультация", "дмс")
FEATURE_CLASS_1 = ("оплату следующих", "медицинских услуг", "диагноз")

CLASS_0_TEMPLATES = (
    "{company}\n\nОрганизовать {services} для пациента {patient_info}.",
    "{company}\n\nНеобходимо провести {services} согласно программе ДМС.",
    "{company}\n\nПросим организовать {services} для застрахованного лица.",
    "{company}\n\nТребуется {services} в рамках полиса ДМС.",
    "{company}\n\nПросим {patient_action} {services} согласно условиям страхования.",
    "{company}\n\nОбеспечить {services} в рамках {program_type}.",
    "{company}\n\nОрганизовать {services} для пациента по полису ДМС.",
)
CLASS_1_TEMPLATES = (
    "{company}\n\nПросим организовать оплату следующих медицинских услуг:\n{service_codes}\n\nДиагноз: {diagnosis}",
    "{company}\n\nНеобходимо оплатить медицинские услуги по кодам:\n{service_codes}\n\nПациент: {patient_info}",
    "{company}\n\nОрганизовать оплату услуг:\n{service_codes}\n\nЗаключение: {diagnosis}",
    "{company}\n\nОплатить следующие процедуры:\n{service_codes}\n\nДиагностическое заключение: {diagnosis}",
    "{company}\n\nГарантируем оплату услуг:\n{service_codes}\n\nПо результатам экспертизы: {diagnosis}",
)
TEMPLATE_COMPANIES = ("СОГАЗ", "Ингосстрах", "СОГАЗ-Мед", "ИНГОССТРАХ")
SERVICES = (
    "необходимые исследования",
    "консультацию специалиста",
    "приемы врача",
    "медицинские процедуры",
    "диагностические мероприятия",
    "лечебные процедуры",
    "консультации врачей",
    "обследование пациента",
    "лабораторные исследования",
    "инструментальную диагностику",
    "терапевтические мероприятия",
)
DIAGNOSES = (
    "Хроническое заболевание",
    "Острое состояние",
    "Профилактическое обследование",
    "Контрольное наблюдение",
    "Диспансерное наблюдение",
    "Реабилитационные мероприятия",
    "Плановое лечение",
    "Экстренная помощь",
)
PATIENT_INFO = (
    "согласно полису ДМС",
    "по программе добровольного медицинского страхования",
    "в рамках страхового полиса",
    "согласно условиям страхования",
    "по договору медицинского страхования",
)
PATIENT_ACTIONS = ("организовать", "обеспечить", "предоставить", "провести")
PROGRAM_TYPES = (
    "программы ДМС",
    "стандартной программы",
    "расширенной программы",
    "базовой программы страхования",
)
CODES_PER_LETTER = 5

# Letters asked of a text generator.
REQUEST_COMPANIES = ("СОГАЗ", "Ингосстрах", "РЕСО-Гарантия", "АльфаСтрахование")
REQUEST_CODE_PREFIXES = ("F59", "F70", "F55", "F71", "F72", "F73", "F74", "F75")
REQUEST_CODES_PER_LETTER = 4
FALLBACK_CLASS_0 = (
    "{company}\n\nОрганизовать необходимые медицинские исследования для пациента в рамках программы добровольного медицинского страхования.",
    "{company}\n\nПросим организовать приемы врача и диагностические процедуры для застрахованного лица согласно полису ДМС.",
    "{company}\n\nТребуется проведение лечебных процедур и консультаций врачей согласно условиям договора медицинского страхования.",
)
FALLBACK_CLASS_1 = (
    "{company}\n\nПросим организовать оплату следующих медицинских услуг:\n{service_codes}\n\nОплата производится в рамках полиса ДМС.",
)
FALLBACK_QUALITY = 0.8
FALLBACK_REASONING = "Fallback template generation"

# --- End of fixed values -----------------------------------------------------

SYSTEM_PROMPTS = (
    "You write Russian insurance correspondence. Produce one guarantee letter "
    "that asks for medical care in general terms and names no service code.",
    "You write Russian insurance correspondence. Produce one guarantee letter "
    "that lists the medical services to be paid for by their codes.",
)
USER_PROMPTS = (
    "Insurer: {company}. Two to four formal sentences about examinations, "
    "consultations or treatment under a voluntary medical insurance programme. "
    "No codes. Return letter_text, quality_score (0-1) and reasoning.",
    "Insurer: {company}. Three to five formal sentences that contain every one of "
    "these codes: {service_codes}. Mention payment under the voluntary medical "
    "insurance policy. Return letter_text, quality_score (0-1) and reasoning.",
)


@dataclass(frozen=True)
class Domain:
    code_pattern: str = CODE_PATTERN
    diagnosis_pattern: str = DIAGNOSIS_PATTERN
    prefix_length: int = 3
    company_patterns: tuple = COMPANY_PATTERNS
    other_company: str = OTHER_COMPANY
    class_0_phrases: tuple = CLASS_0_PHRASES
    class_1_phrases: tuple = CLASS_1_PHRASES
    feature_companies: tuple = FEATURE_COMPANIES
    feature_class_0: tuple = FEATURE_CLASS_0
    feature_class_1: tuple = FEATURE_CLASS_1
    class_0_templates: tuple = CLASS_0_TEMPLATES
    class_1_templates: tuple = CLASS_1_TEMPLATES
    template_companies: tuple = TEMPLATE_COMPANIES
    services: tuple = SERVICES
    diagnoses: tuple = DIAGNOSES
    patient_info: tuple = PATIENT_INFO
    patient_actions: tuple = PATIENT_ACTIONS
    program_types: tuple = PROGRAM_TYPES
    codes_per_letter: int = CODES_PER_LETTER
    request_companies: tuple = REQUEST_COMPANIES
    request_code_prefixes: tuple = REQUEST_CODE_PREFIXES
    request_codes_per_letter: int = REQUEST_CODES_PER_LETTER
    system_prompts: tuple = SYSTEM_PROMPTS
    user_prompts: tuple = USER_PROMPTS
    fallback_class_0: tuple = FALLBACK_CLASS_0
    fallback_class_1: tuple = FALLBACK_CLASS_1

    def with_(self, **changes) -> "Domain":
        """A copy with some parameters changed."""
        return replace(self, **changes)


DEFAULT = Domain()
