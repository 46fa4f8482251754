"""Dimensions. Nicknames, investor types, stages, keywords, patterns and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NICKNAMES = {
    "robert": ["bob", "rob", "bobby"], "william": ["bill", "will", "billy"], "richard": ["rick", "dick", "rich"], "james": ["jim", "jimmy", "jamie"],
    "michael": ["mike", "mikey"], "christopher": ["chris"], "matthew": ["matt"], "daniel": ["dan", "danny"], "joseph": ["joe", "joey"], "anthony": ["tony"],
    "thomas": ["tom", "tommy"], "charles": ["chuck", "charlie"], "david": ["dave", "davey"], "andrew": ["andy", "drew"], "benjamin": ["ben", "benny"],
    "alexander": ["alex"], "jonathan": ["jon", "johnny"], "nicholas": ["nick"], "samuel": ["sam"], "timothy": ["tim"],
    "elizabeth": ["liz", "beth", "betty", "lizzie"], "katherine": ["kate", "katie", "kathy"], "margaret": ["maggie", "meg", "peggy"], "jennifer": ["jen", "jenny"],
    "jessica": ["jess"], "patricia": ["pat", "patty", "tricia"], "rebecca": ["becky", "becca"], "deborah": ["deb", "debbie"], "susan": ["sue", "susie"],
    "christine": ["chris", "christina"], "kimberly": ["kim"], "michelle": ["mich", "shelly"], "amanda": ["mandy"], "stephanie": ["steph"], "victoria": ["vicky", "tori"],
}
SKIP_DOMAINS = ["twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "google.com", "apple.com", "microsoft.com"]
GENERIC_MAILBOXES = ["info", "contact", "hello", "support", "admin", "team", "press", "media", "careers", "jobs", "hr", "sales", "marketing", "legal", "privacy", "security", "noreply", "no-reply", "webmaster", "postmaster"]
#: (category, priority, parts of the URL, parts of the link's text), the first that fits wins.
PAGE_CATEGORIES = [
    ("team", 1, ["/team", "/people", "/about-us", "/leadership", "/partners", "/our-team", "/meet-the-team", "/management", "/executives", "/investment-team", "/professionals"], ["team", "people", "leadership", "partners", "our team", "meet the team"]),
    ("portfolio", 2, ["/portfolio", "/companies", "/investments", "/our-portfolio", "/portfolio-companies", "/our-companies", "/what-we-invest-in"], ["portfolio", "companies", "investments", "our portfolio"]),
    ("about", 3, ["/about", "/who-we-are", "/our-story", "/mission", "/values", "/philosophy", "/approach", "/overview"], ["about", "who we are", "our story", "mission", "values", "philosophy"]),
    ("news", 5, ["/news", "/blog", "/insights", "/press", "/media", "/articles", "/updates", "/announcements"], ["news", "blog", "insights", "press", "media", "articles"]),
    ("contact", 4, ["/contact", "/get-in-touch", "/reach-us"], ["contact", "get in touch", "reach us"]),
]
CATEGORY_CAPS = {"team": 5, "portfolio": 3, "about": 2, "news": 2, "contact": 3, "other": 3}
#: (class, parts of the message or a regular expression), the first that fits wins.
ERRORS = [
    ("scraper_blocked", "403|blocked|rate limit|429"),
    ("http_error", "(^|[^a-z0-9_])[45][0-9][0-9]($|[^a-z0-9_])|timeout|econnreset|econnrefused"),
    ("no_content", "no content|empty page|no text"),
    ("llm_empty", "llm|openai|parse"),
]
#: (message, parts of the error), the first that fits wins: of a check of a site, and of a verification.
SITE_ERRORS = [
    ("Domain does not exist or DNS lookup failed", "enotfound|dns"),
    ("Website timeout - site may be slow or temporarily unavailable", "timeout|etimedout"),
    ("Connection refused - server may be down", "econnrefused|connection refused"),
    ("Access blocked - website has anti-bot protection", "403|forbidden"),
    ("Page not found (404)", "404|not found"),
    ("Circuit breaker open - domain temporarily blocked due to repeated failures", "circuit breaker"),
]
VERIFICATION_ERRORS = [
    ("Verification temporarily unavailable (rate limit)", "412|429|rate limit|usage exhausted"),
    ("Verification timed out", "timeout|timed out"),
    ("Website not accessible (404)", "404|not found"),
    ("Website blocked access (403)", "403|forbidden"),
    ("Website server error", "500|502|503"),
    ("Website domain not found", "enotfound|dns"),
    ("Website connection refused", "econnrefused|connection refused"),
]
PORTFOLIO_WORDS = ["portfolio", "investment", "companies", "holdings"]
CONFIDENCE = {"High": 90, "Medium": 60}
OTHER_CONFIDENCE = 30
#: Tokens of each operation for a firm: (name, input, output, grows with the description's length, how many times).
OPERATIONS = [
    ("websiteVerification", 500, 50, False, 1.0), ("investorType", 1500, 100, False, 1.0), ("investmentStages", 1500, 100, False, 1.0), ("niches", 2000, 100, False, 1.0),
    ("teamMembers", 3000, 800, True, 1.0), ("portfolioCompanies", 8000, 1500, True, 1.0), ("waterfallRetry", 3000, 150, False, 0.6),
]
PRICE_IN, PRICE_OUT = 0.15, 0.60
VARIANCE = 0.45


def nicknames(spark: SparkSession) -> DataFrame:
    """(name, variant, ord, at): both directions; a nickname leads to the first full name that lists it."""
    rows = [(k, v, i, j) for i, (k, vs) in enumerate(NICKNAMES.items()) for j, v in enumerate(vs)]
    seen = set()
    for i, (k, vs) in enumerate(NICKNAMES.items()):
        for v in vs:
            if v not in seen and v not in NICKNAMES:
                seen.add(v)
                rows.append((v, k, i, 0))
    return spark.createDataFrame(rows, "name string, variant string, ord int, at int")


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)

# Taxonomies with their keywords, niches, profiles, and paths that sites use.
INVESTOR_TYPES = {
    "Venture Capital (VC)": ["venture capital", "vc firm", "venture fund", "vc fund", "venture partners"], "Angel Network": ["angel network", "angel group", "angel investors", "angel syndicate"],
    "Private Equity (PE)": ["private equity", "pe firm", "buyout", "growth equity", "pe fund"], "Accelerator": ["accelerator", "startup accelerator", "cohort", "demo day", "acceleration program"],
    "Incubator": ["incubator", "startup incubator", "innovation lab", "entrepreneurship center"], "Venture Studio": ["venture studio", "startup studio", "company builder", "venture builder"],
    "Corporate Venture Capital (CVC)": ["corporate venture", "cvc", "corporate vc", "strategic investment"], "Family Office": ["family office", "single family office", "multi-family office", "private wealth"],
    "Micro VC": ["micro vc", "micro fund", "emerging manager", "small fund"], "Venture Debt": ["venture debt", "venture lending", "growth debt", "debt financing"],
    "Crowdfunding Platform": ["crowdfunding", "equity crowdfunding", "crowdfund", "syndicate platform"], "Government Fund": ["government fund", "public investment", "sovereign fund", "innovation fund"],
}
INVESTMENT_STAGES = {
    "Pre-Seed": ["pre-seed", "preseed", "friends and family", "pre seed"], "Seed": ["seed", "seed round", "seed stage", "seed funding"], "Series A": ["series a", "series-a", "round a", "series a round"],
    "Series B": ["series b", "series-b", "round b", "series b round"], "Series C": ["series c", "series-c", "round c", "series c round"], "Series D+": ["series d", "series e", "series f", "late stage", "late-stage"],
    "Growth/Expansion": ["growth", "expansion", "growth equity", "growth stage", "scale-up"], "Bridge": ["bridge", "bridge round", "bridge financing", "interim financing"],
    "Mezzanine": ["mezzanine", "mezzanine financing", "subordinated debt"], "IPO/Public": ["ipo", "public offering", "public markets", "crossover"],
}
NICHES = {
    "Technology / Software": {
        "Artificial Intelligence (AI) & Machine Learning (ML)": ["Generative AI", "AI-driven Healthcare", "AI in Cybersecurity", "AI in Education (EdTech)", "AI Agents & Autonomous Systems"],
        "Software as a Service (SaaS)": ["Enterprise Software", "B2B Software"], "Cybersecurity": ["Threat Detection & Response", "Data Security", "Confidential AI"],
        "Financial Technology (FinTech)": ["Decentralized Finance (DeFi) / Blockchain", "Digital Payments & Lending", "InsurTech"], "Cloud Computing & Infrastructure": [],
        "Internet & Digital Media": ["E-commerce & Marketplaces", "Social Media & Consumer Tech", "Media & Entertainment"],
    },
    "Healthcare & Life Sciences": {"Biotechnology (BioTech)": ["Gene Therapy & Personalized Medicine"], "Digital Health & HealthTech": ["Telemedicine / Remote Healthcare", "Health & Wellness Apps"], "Medical Devices & Equipment": [], "Women's Health (FemTech)": []},
    "Green Technology & Sustainability": {"Clean Technology (CleanTech)": ["Renewable Energy (Solar, Wind)", "Energy Storage & Battery Technology", "Electric Vehicles (EVs)"], "Sustainability": ["Carbon Capture", "Alternative Proteins & Food Tech", "Circular Economy & Eco-friendly Packaging"], "Agricultural Technology (AgriTech)": ["Vertical Farming"]},
    "Advanced & Frontier Technologies": {"Advanced Computing": ["Quantum Computing", "Semiconductors"], "Robotics & Automation": ["Cobots (Collaborative Robots)"], "Aerospace & Transportation": [], "Deep Tech": []},
}
SPECIALISATIONS = ["fintech", "healthtech", "biotech", "saas", "enterprise", "consumer", "b2b", "b2c", "ai", "ml", "crypto", "web3", "climate", "cleantech", "edtech", "proptech", "marketplace", "infrastructure", "devtools", "security", "cybersecurity"]
FILING_STRATEGIES = ["venture capital", "early stage", "seed stage", "growth equity", "private equity", "angel investment"]
FILING_ASSETS = ["technology", "healthcare", "fintech", "saas", "biotech", "consumer", "enterprise software"]
TEMPLATE_PROFILES = {"vc": "vc", "b2b": "general", "people": "directory_entry", "healthcare": "healthcare", "ecommerce": "ecommerce", "realestate": "general", "local": "general"}
#: (path, priority) of the pages that are tried in turn.
WATERFALL_PATHS = [("", 1), ("/about", 2), ("/about-us", 2), ("/team", 3), ("/people", 3), ("/portfolio", 4), ("/investments", 4), ("/companies", 4), ("/focus", 5), ("/investment-focus", 5), ("/thesis", 5), ("/strategy", 5)]
PORTFOLIO_PATHS = ["/portfolio", "/companies", "/investments", "/portfolio-companies", "/our-companies", "/our-investments", "/our-portfolio", "/ventures", "/current-holdings", "/direct-investments", "/featured", "/portfolio-co", "/what-we-do", "/investment-portfolio", "/fund-investments", "/our-ventures", ""]
#: Output columns of each template: sheets, and the labels of their fields in order.
TEMPLATE_SHEETS = {
    "vc": {
        "firms": {"company_name": "Firm Name", "website_url": "Website", "description": "Description", "investor_type": "Investor Type", "investment_stages": "Investment Stages", "investment_niches": "Focus Areas", "aum": "AUM", "founded_year": "Founded", "headquarters": "Headquarters", "investment_thesis": "Investment Thesis", "website_verified": "Website Verified"},
        "team": {"vc_firm": "Firm", "name": "Name", "title": "Title", "decision_maker_tier": "Tier", "linkedin_url": "LinkedIn", "email": "Email", "investment_focus": "Investment Focus", "stage_preference": "Stage Preference", "check_size_range": "Check Size", "geographic_focus": "Geography", "notable_investments": "Notable Investments", "background": "Background"},
        "portfolio": {"vc_firm": "Investor", "portfolio_company": "Company", "investment_date": "Investment Date", "website_url": "Website", "investment_niche": "Sector", "recency_category": "Recency"},
    },
    "b2b": {
        "firms": {"company_name": "Company Name", "website_url": "Website", "description": "About", "investor_type": "Organization Type", "investment_niches": "Industry Tags", "headquarters": "Location", "founded_year": "Founded", "aum": "Revenue / Size", "sector_focus": "Sectors Served", "geographic_focus": "Markets"},
        "team": {"vc_firm": "Company", "name": "Name", "title": "Title", "job_function": "Function", "linkedin_url": "LinkedIn", "email": "Email", "specialization": "Specialization", "background": "Background"},
        "portfolio": {"vc_firm": "Company", "portfolio_company": "Client / Project", "investment_niche": "Industry", "investment_date": "Year", "website_url": "Reference URL"},
    },
    "people": {
        "team": {"name": "Name", "vc_firm": "Organization", "title": "Title / Role", "decision_maker_tier": "Seniority Level", "job_function": "Function", "specialization": "Specialization", "linkedin_url": "LinkedIn", "email": "Email", "geographic_focus": "Location", "background": "Background", "years_experience": "Experience", "notable_investments": "Notable Work"},
        "firms": {"company_name": "Organization Name", "website_url": "Website", "description": "About", "investor_type": "Type", "headquarters": "Location"},
    },
    "healthcare": {
        "firms": {"company_name": "Organization Name", "website_url": "Website", "description": "Overview", "investor_type": "Facility Type", "investment_niches": "Specialties", "headquarters": "Location", "sector_focus": "Services Offered", "geographic_focus": "Service Area"},
        "team": {"vc_firm": "Organization", "name": "Name", "title": "Title", "job_function": "Role", "investment_focus": "Medical Specialty", "linkedin_url": "Profile URL", "email": "Contact", "background": "Credentials"},
    },
    "ecommerce": {
        "firms": {"company_name": "Store Name", "website_url": "Website", "description": "About", "investor_type": "Store Type", "investment_niches": "Product Categories", "headquarters": "Location", "geographic_focus": "Ships To", "aum": "Est. Revenue"},
        "portfolio": {"vc_firm": "Store", "portfolio_company": "Product / Category", "investment_niche": "Category", "website_url": "Listing URL", "investment_date": "Listed"},
        "team": {"vc_firm": "Store", "name": "Name", "title": "Role", "email": "Email", "linkedin_url": "LinkedIn"},
    },
    "realestate": {
        "firms": {"company_name": "Agency Name", "website_url": "Website", "description": "About", "investor_type": "Agency Type", "investment_niches": "Property Types", "headquarters": "Location", "geographic_focus": "Markets Served", "aum": "Portfolio Size"},
        "team": {"vc_firm": "Agency", "name": "Agent Name", "title": "Title", "email": "Email", "linkedin_url": "Profile URL", "specialization": "Specialty", "geographic_focus": "Territory", "background": "Experience"},
        "portfolio": {"vc_firm": "Agency", "portfolio_company": "Property", "investment_niche": "Type", "website_url": "Listing URL", "investment_date": "Listed / Sold"},
    },
    "directory": {
        "firms": {"company_name": "Company Name", "website_url": "Website", "description": "Description", "investment_niches": "Services / Products", "aum": "Team Size", "headquarters": "Location", "founded_year": "Founded", "investor_type": "Key Contact"},
    },
    "local": {
        "firms": {"company_name": "Business Name", "website_url": "Website", "description": "About", "investor_type": "Business Type", "investment_niches": "Categories", "headquarters": "Address", "geographic_focus": "Service Area"},
        "team": {"vc_firm": "Business", "name": "Contact Name", "title": "Role", "email": "Email", "linkedin_url": "Profile URL"},
    },
}
STANDARD_PATHS = ["/team", "/people", "/about-us", "/leadership", "/our-team", "/partners", "/management", "/professionals", "/portfolio", "/companies", "/investments", "/our-portfolio", "/about", "/about-us"]
TEAM_PATHS = ["/team", "/people", "/our-team", "/about/team", "/leadership", "/partners", "/about", "/about-us", "/who-we-are", "/our-people"]
TEAM_FALLBACK_PATHS = ["/team", "/people", "/leadership", "/our-team", "/meet-the-team", "/partners", "/investment-team", "/about/team", "/about/people", "/about", "/about-us", "/who-we-are", ""]
#: The lists of paths by name.
PATH_LISTS = {"waterfall": [p for p, _ in WATERFALL_PATHS], "standard": STANDARD_PATHS, "portfolio": PORTFOLIO_PATHS, "team": TEAM_PATHS, "team_fallback": TEAM_FALLBACK_PATHS}


def niche_labels() -> list[tuple[str, str, str]]:
    """(category, sub-category, label) of every level, the short name in brackets too."""
    import re

    out = []
    for cat, subs in NICHES.items():
        for sub, leaves in subs.items():
            for label in (sub, *leaves):
                out.append((cat, sub, label))
                if m := re.search(r"\((\w+)\)$", label):
                    out.append((cat, sub, m[1]))
    return out
