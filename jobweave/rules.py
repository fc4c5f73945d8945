"""Word lists, lookup tables and constants the results depend on.

Every table below is a fixed value.  Operators take them as default arguments,
so a caller can pass other tables.  Where a rule is "first hit wins" the order
of the entries is part of the rule.
"""

# --- money -----------------------------------------------------------------
VND_PER_USD = 25_500
SALARY_FLOOR_USD = 50
SALARY_CEIL_USD = 50_000
SALARY_REPORT_CAP_USD = 10_000
ENRICH_FLOOR_USD = 100
ENRICH_CEIL_USD = 50_000

# --- dates -----------------------------------------------------------------
ANALYSIS_START = "2025-01-01"
ANALYSIS_END = "2026-05-14"
REFERENCE_DATE = "2026-05-15"
ASSUMED_ACTIVE_DAYS = 90

# --- salary words ----------------------------------------------------------
NEGOTIABLE_WORDS = [
    "thỏa thuận", "thoả thuận", "thoa thuan", "negotiable", "competitive",
    "đang cập nhật", "dang cap nhat", "cạnh tranh", "canh tranh",
    "attractive", "hấp dẫn", "hap dan", "you'll love it",
    "sign in to view", "login to view", "theo kinh nghiệm",
]
VND_WORDS = ["triệu", "trieu", "vnd", "vnđ", "đồng", "tr/th"]
UPPER_BOUND_WORDS = ["upto", "up to", "tối đa"]
LOWER_BOUND_WORDS = ["from", "từ", "tối thiểu"]
UPPER_BOUND_FACTOR = 0.7
LOWER_BOUND_FACTOR = 1.4

INGEST_NEGOTIABLE_WORDS = [
    "thỏa thuận", "thoả thuận", "thoa thuan",
    "cạnh tranh", "canh tranh",
    "hấp dẫn", "hap dan",
    "negotiate", "negotiable",
    "competitive", "attractive",
    "market rate", "based on", "according to",
    "you'll love it", "you will love it",
    "sign in to view", "login to view",
    "see details", "to be discussed",
    "upon interview", "upto",
]
INGEST_MILLION_WORDS = ["triệu", "million", " tr "]
INGEST_THOUSAND_WORDS = ["nghìn", "thousand", "k vnd"]

# --- company legal forms, removed in this order -----------------------------
LEGAL_FORM_PATTERNS = [
    r"\bCÔNG TY TNHH\b",
    r"\bCÔNG TY CỔ PHẦN\b",
    r"\bCÔNG TY CP\b",
    r"\bC\.P\.\b",
    r"\bJSC\b",
    r"\bLTD\b",
    r"\bLLC\b",
    r"\bINC\b",
    r"\bCO\.\s*LTD\b",
]

# --- location: first substring hit wins --------------------------------------
LOCATION_MAP = {
    "hcm": "Ho Chi Minh City",
    "hồ chí minh": "Ho Chi Minh City",
    "tp.hcm": "Ho Chi Minh City",
    "tp hcm": "Ho Chi Minh City",
    "tphcm": "Ho Chi Minh City",
    "sài gòn": "Ho Chi Minh City",
    "saigon": "Ho Chi Minh City",
    "hn": "Hanoi",
    "hà nội": "Hanoi",
    "ha noi": "Hanoi",
    "hanoi": "Hanoi",
    "đà nẵng": "Da Nang",
    "da nang": "Da Nang",
    "cần thơ": "Can Tho",
    "can tho": "Can Tho",
    "remote": "Remote",
    "toàn quốc": "Nationwide",
}
REMOTE_LOCATION_WORDS = ["remote", "từ xa", "work from home"]
CITY_SYNONYMS = {
    "Ho Chi Minh": "Ho Chi Minh City",
    "Hồ Chí Minh": "Ho Chi Minh City",
    "HCM": "Ho Chi Minh City",
    "Hai Phong": "Hai Phong",
    "Hải Phòng": "Hai Phong",
}
EMPLOYMENT_SYNONYMS = {"Full Time": "Full-time", "FULL_TIME": "Full-time"}
HCM_KEYS = ["Ho Chi Minh City", "Ho Chi Minh", "Hồ Chí Minh", "HCM", "HCMC"]
HANOI_KEYS = ["Hanoi", "Hà Nội", "Ha Noi", "HN"]

# --- skills ------------------------------------------------------------------
SKILL_TAXONOMY = {
    "programming_languages": [
        "Python", "R", "SQL", "Scala", "Java", "C++", "Julia",
        "Go", "Rust", "JavaScript", "TypeScript",
    ],
    "ml_frameworks": [
        "PyTorch", "TensorFlow", "Keras", "JAX", "MXNet",
        "Scikit-learn", "XGBoost", "LightGBM", "CatBoost",
        "Hugging Face", "Transformers", "ONNX",
    ],
    "data_tools": [
        "Pandas", "NumPy", "Dask", "PySpark", "Apache Spark",
        "Airflow", "dbt", "Great Expectations",
        "SQL", "PostgreSQL", "MySQL", "SQLite",
    ],
    "cloud_platforms": [
        "AWS", "GCP", "Azure", "S3", "EC2", "GCS",
        "BigQuery", "Redshift", "Databricks", "Snowflake",
    ],
    "mlops_tools": [
        "MLflow", "Kubeflow", "BentoML", "Seldon", "Ray",
        "Docker", "Kubernetes", "Terraform", "CI/CD",
        "GitHub Actions", "Jenkins",
    ],
    "visualization_tools": [
        "Matplotlib", "Seaborn", "Plotly", "Tableau",
        "Power BI", "Grafana", "Superset",
    ],
    "nlp_tools": [
        "spaCy", "NLTK", "Gensim", "BERTopic", "LangChain",
        "OpenAI", "GPT", "BERT", "LLaMA", "Llama",
    ],
    "computer_vision": [
        "OpenCV", "YOLO", "detectron2", "MMDetection",
        "PIL", "Albumentations", "torchvision",
    ],
    "databases": [
        "MongoDB", "Redis", "Elasticsearch", "Cassandra",
        "Neo4j", "Pinecone", "Weaviate", "ChromaDB",
    ],
    "soft_skills": [
        "English", "Communication", "Teamwork",
        "Problem Solving", "Agile", "Scrum",
    ],
}

EXTRA_SKILLS = [
    "Node.js", "React", "Vue", "Angular", "SQL Server", "Machine Learning",
    "Deep Learning", "Computer Vision", "Generative AI", "NLP", "ETL", "ELT",
    "Excel", "Looker", "FastAPI", "Flask", "Django", "Git", "Linux",
    "NoSQL", "REST API", "Microservices", "Statistics", "A/B Testing",
    "Data Modeling", "Data Warehouse", "Data Lake", "Business Intelligence",
]

# alias -> canonical, used when the skill list of a posting is cleaned
SKILL_LIST_ALIASES = {
    "pytorch": "PyTorch", "torch": "PyTorch",
    "tensorflow": "TensorFlow", "tf": "TensorFlow",
    "sklearn": "Scikit-learn", "scikit learn": "Scikit-learn",
    "scikit-learn": "Scikit-learn",
    "numpy": "NumPy", "np": "NumPy",
    "pandas": "Pandas", "pd": "Pandas",
    "js": "JavaScript", "javascript": "JavaScript", "es6": "JavaScript",
    "ts": "TypeScript", "typescript": "TypeScript",
    "nodejs": "Node.js", "node js": "Node.js", "node.js": "Node.js",
    "reactjs": "React", "react.js": "React", "react js": "React",
    "vuejs": "Vue.js", "vue js": "Vue.js", "vue.js": "Vue.js",
    "angularjs": "Angular", "angular js": "Angular",
    "mysql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "mongodb": "MongoDB", "mongo": "MongoDB",
    "elasticsearch": "Elasticsearch", "elastic": "Elasticsearch",
    "k8s": "Kubernetes", "kube": "Kubernetes",
    "aws": "AWS", "amazon web services": "AWS",
    "gcp": "GCP", "google cloud": "GCP",
    "azure": "Azure", "microsoft azure": "Azure",
    "docker": "Docker", "dockerfile": "Docker",
    "git": "Git", "github": "Git", "gitlab": "Git",
    "ci/cd": "CI/CD", "cicd": "CI/CD",
    "ml": "Machine Learning", "machine learning": "Machine Learning",
    "dl": "Deep Learning", "deep learning": "Deep Learning",
    "ai": "AI", "artificial intelligence": "AI",
    "nlp": "NLP", "natural language processing": "NLP",
    "cv": "Computer Vision", "computer vision": "Computer Vision",
    "llm": "LLM", "large language model": "LLM",
    "rag": "RAG", "retrieval augmented generation": "RAG",
    "java": "Java", "spring": "Spring Boot", "spring boot": "Spring Boot",
    "python": "Python", "py": "Python",
    "golang": "Go", "go lang": "Go",
    "c#": "C#", ".net": ".NET", "dotnet": ".NET",
    "php": "PHP", "laravel": "Laravel",
    "swift": "Swift", "kotlin": "Kotlin",
    "flutter": "Flutter", "dart": "Flutter",
    "react native": "React Native",
    "sql": "SQL", "nosql": "NoSQL",
    "redis": "Redis", "kafka": "Kafka",
    "grafana": "Grafana", "kibana": "Kibana",
    "tableau": "Tableau", "power bi": "Power BI", "powerbi": "Power BI",
    "excel": "Excel", "vba": "VBA",
    "scrum": "Scrum", "agile": "Agile", "kanban": "Kanban",
}

# alias -> canonical, used when skills are found in free text
SKILL_TEXT_ALIASES = {
    "js": "JavaScript",
    "nodejs": "Node.js",
    "node.js": "Node.js",
    "reactjs": "React",
    "react.js": "React",
    "vuejs": "Vue",
    "vue.js": "Vue",
    "angularjs": "Angular",
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
    "mysql": "MySQL",
    "mssql": "SQL Server",
    "ms sql": "SQL Server",
    "sql server": "SQL Server",
    "scikit learn": "Scikit-learn",
    "sklearn": "Scikit-learn",
    "pyspark": "PySpark",
    "spark": "Apache Spark",
    "powerbi": "Power BI",
    "power bi": "Power BI",
    "gcp": "GCP",
    "google cloud": "GCP",
    "amazon web services": "AWS",
    "k8s": "Kubernetes",
    "ci cd": "CI/CD",
    "cicd": "CI/CD",
    "llm": "LLM",
    "llms": "LLM",
    "gen ai": "Generative AI",
    "genai": "Generative AI",
    "generative ai": "Generative AI",
    "machine learning": "Machine Learning",
    "deep learning": "Deep Learning",
    "computer vision": "Computer Vision",
    "natural language processing": "NLP",
    "nlp": "NLP",
    "etl": "ETL",
    "elt": "ELT",
    "excel": "Excel",
    "looker": "Looker",
    "fastapi": "FastAPI",
    "flask": "Flask",
    "django": "Django",
    "git": "Git",
    "linux": "Linux",
}

# soft skills left out of dashboard skill lists (lower case)
SOFT_SKILLS = [
    "communication", "teamwork", "leadership", "problem solving", "critical thinking",
    "time management", "agile", "scrum", "english", "presentation", "analytical",
    "microsoft office", "word", "excel", "powerpoint", "work", "ability", "experience",
    "knowledge", "skill", "team", "project", "management", "customer", "service",
]
# skills left out of the exploratory charts (case-sensitive)
CHART_EXCLUDED_SKILLS = [
    "English", "Communication", "Agile", "Scrum", "Leadership", "Teamwork",
    "Problem Solving", "Analytical Skills", "Time Management", "", "Presentation",
    "Critical Thinking", "Vietnamese", "Microsoft Office", "Excel", "Word", "PowerPoint", "OOP",
]
SKILL_FAMILIES = {
    "Programming Languages": [
        "python", "java", "javascript", "typescript", "go", "golang", "c++", "scala", "r",
        "kotlin", "swift", "php",
    ],
    "Databases & Storage": [
        "sql", "mysql", "postgresql", "mongodb", "redis", "elasticsearch", "cassandra",
        "oracle", "sqlite",
    ],
    "Cloud & DevOps": [
        "aws", "azure", "gcp", "docker", "kubernetes", "ci/cd", "terraform", "jenkins",
        "linux", "git",
    ],
    "ML/AI & Big Data": [
        "pytorch", "tensorflow", "scikit-learn", "pandas", "numpy", "keras", "spark",
        "hadoop", "airflow", "kafka",
    ],
    "Web Frameworks": [
        "react", "vue", "angular", "html", "css", "node.js", "spring", "django", "fastapi",
        ".net",
    ],
}
FOCUS_SKILLS = [
    "Python", "SQL", "Java", "AWS", "Docker", "Kubernetes", "PyTorch", "TensorFlow",
    "Spark", "Power BI", "Tableau", "Scikit-learn", "PostgreSQL", "MongoDB",
    "Git", "CI/CD", "Azure", "GCP", "Airflow", "R", "Scala", "JavaScript",
]

# --- roles: ordered rules, first hit wins -------------------------------------
DASHBOARD_ROLES = {
    "Data Analyst": ["data analyst", "business intelligence", "bi analyst", "reporting analyst",
                     "phân tích dữ liệu"],
    "Business Analyst": ["business analyst", "system analyst", "systems analyst",
                         "product analyst"],
    "Data Engineer": ["data engineer", "etl engineer", "data pipeline", "data platform",
                      "kỹ sư dữ liệu"],
    "AI/ML Engineer": ["ai engineer", "ml engineer", "machine learning engineer",
                       "deep learning", "nlp engineer", "computer vision engineer",
                       "artificial intelligence"],
    "Data Scientist": ["data scientist", "research scientist", "applied scientist",
                       "khoa học dữ liệu"],
    "MLOps/DevOps": ["mlops", "devops engineer", "platform engineer", "cloud engineer",
                     "site reliability", "sre"],
    "Software Engineer": ["software engineer", "backend engineer", "frontend engineer",
                          "fullstack", "full stack", "lập trình viên", "developer"],
    "Manager/Lead": ["manager", "head of data", "head of ai", "director", "chief data",
                     "tech lead", "data lead", "trưởng nhóm"],
    "Database/DBA": ["dba", "database administrator", "database engineer", "sql developer"],
    "Intern/Fresher": ["intern", "thực tập", "fresher", "trainee", "graduate"],
}
DASHBOARD_ROLE_OTHER = "Khác"
CHART_ROLES = {
    "Data Scientist": ["data scientist", "data science"],
    "Data Analyst": ["data analyst", "data analysis"],
    "Data Engineer": ["data engineer"],
    "ML Engineer": ["machine learning", "ml engineer"],
    "AI Engineer": ["ai engineer", "agentic", "llm engineer"],
    "BI Analyst/Dev": ["business intelligence", "bi developer", "bi analyst"],
    "Business Analyst": ["business analyst"],
    "DevOps/MLOps": ["devops", "mlops", "platform engineer", "sre"],
    "Backend Developer": ["backend", "back-end"],
    "Frontend Developer": ["frontend", "front-end"],
    "Fullstack Developer": ["fullstack", "full stack", "full-stack"],
    "Software Engineer": ["software engineer", "software developer"],
    "Security Engineer": ["security", "information security"],
    "Tech Lead": ["tech lead", "technical lead", "lead developer", "lead engineer"],
    "AI/ML Researcher": ["nlp", "computer vision", "deep learning"],
    "Cloud/Infra Engineer": ["cloud", "infrastructure"],
}
CHART_ROLE_OTHER = "Other IT Role"
COARSE_ROLES = {
    "Engineering": ["engineer", "developer"],
    "Data Science": ["scientist", "machine learning", "ml"],
    "Analytics": ["analyst", "analytics"],
    "Product": ["product"],
    "Management": ["manager"],
    "Research": ["research", "researcher"],
    "Consulting": ["consultant"],
    "Business": ["business"],
}
COARSE_ROLE_OTHER = "Other"
HEATMAP_ROLES = ["Data Analyst", "Data Engineer", "Data Scientist", "AI Engineer",
                 "ML Engineer", "BI Analyst/Dev", "DevOps/MLOps"]
COMPANY_FOCUS_ROLES = ["Data Analyst", "Data Engineer", "Data Scientist", "AI Engineer",
                       "ML Engineer", "Software Engineer", "Business Analyst", "DevOps/MLOps"]
TREND_ROLES = ["Data Analyst", "Data Engineer", "AI Engineer", "ML Engineer", "Data Scientist"]

# --- experience ---------------------------------------------------------------
LEVEL_ORDER = ["intern", "fresher", "junior", "mid", "senior", "lead"]
NO_EXPERIENCE_WORDS = ["fresher", "fresh grad", "intern", "thực tập",
                       "0 year", "no experience", "không yêu cầu"]
# (pattern, divisor): first pattern whose value lies in 0..20 wins
EXPERIENCE_PATTERNS = [
    (r"(\d+)\s*\+?\s*(?:to|-)\s*(\d+)\s*(?:year|yr|năm)", 1),
    (r"(\d+)\s*\+\s*(?:year|yr|năm)", 1),
    (r"(\d+)\s*(?:year|yr|năm)s?", 1),
    (r"(?:ít nhất|tối thiểu|at least|minimum)\s*(\d+)", 1),
    (r"(?:từ|from)\s*(\d+)\s*(?:year|yr|năm)", 1),
    (r"(\d+)\s*month", 12),
]
EXPERIENCE_MAX_YEARS = 20
TITLE_YEARS = [
    (["intern", "thực tập", "trainee"], 0.0),
    (["fresher", "fresh"], 0.0),
    (["junior", "jr.", "entry"], 0.5),
    (["senior", "sr."], 5.0),
]
TITLE_LEVELS = [
    ("lead", ["lead", "head", "manager", "director", "principal", "trưởng nhóm", "trưởng phòng"]),
    ("senior", ["senior", "sr.", "cao cấp"]),
    ("fresher", ["fresher", "fresh grad"]),
    ("junior", ["junior", "jr.", "entry"]),
]
INTERN_WORDS = ["intern", "thực tập", "trainee"]
FIELD_LEVELS = [
    ("senior", ["senior", "cao cấp"]),
    ("junior", ["junior", "fresher"]),
    ("lead", ["lead", "manager"]),
    ("intern", ["intern"]),
]
# (exclusive upper bound in years, level); 0 years is 'fresher', above the last is 'lead'
LEVEL_BANDS = [(3, "junior"), (5, "mid"), (8, "senior")]

# job level from title, per family of sources: ordered (level, words)
SOURCE_LEVEL_RULES = {
    "careerviet": [
        ("Lead", ["lead", "head", "manager", "director", "trưởng"]),
        ("Senior", ["senior", "sr.", "principal", "expert"]),
        ("Junior", ["junior", "fresher", "jr.", "entry"]),
        ("Intern", ["intern", "thực tập", "trainee"]),
    ],
    "topcv": [
        ("Lead", ["lead", "head", "manager", "director", "trưởng phòng"]),
        ("Senior", ["senior", "sr.", "principal"]),
        ("Junior", ["junior", "fresher", "jr.", "entry"]),
        ("Intern", ["intern", "thực tập", "trainee"]),
    ],
    "topdev": [
        ("Lead", ["lead", "head", "manager", "director", "trưởng"]),
        ("Senior", ["senior", "sr.", "principal", "expert"]),
        ("Junior", ["junior", "fresher", "jr.", "entry", "intern", "trainee"]),
        ("Intern", ["intern", "thực tập", "trainee"]),
    ],
    "linkedin": [
        ("Lead", ["lead", "head", "manager", "director", "principal", "staff"]),
        ("Senior", ["senior", "sr.", "expert"]),
        ("Junior", ["junior", "fresher", "jr.", "entry", "associate", "intern"]),
    ],
    "vietnamworks": [
        ("Lead", ["manager", "director", "head", "lead", "principal", "trưởng"]),
        ("Senior", ["senior", "experienced", "cao cấp", "sr."]),
        ("Junior", ["junior", "fresher", "entry", "jr.", "intern", "thực tập"]),
    ],
    "itviec": [
        ("Lead", ["lead", "manager", "director", "head of"]),
        ("Senior", ["senior", "sr.", "principal"]),
        ("Junior", ["junior", "jr.", "fresher", "entry"]),
        ("Intern", ["intern", "internship", "thực tập"]),
    ],
}
SOURCE_LEVEL_RULES["job123"] = SOURCE_LEVEL_RULES["careerviet"]
SOURCE_LEVEL_DEFAULT = "Mid-level"

# --- ingest -------------------------------------------------------------------
EMPLOYMENT_CODES = {"FULL_TIME": "Full-time", "PART_TIME": "Part-time",
                    "CONTRACT": "Contract", "INTERN": "Internship"}
WORKING_TYPE_CODES = {1: "Full-time", 2: "Part-time", 3: "Contract",
                      4: "Internship", 5: "Freelance", 6: "Remote"}
DEFAULT_INDUSTRY = "IT / Technology"
ENRICHED_LEVELS = ["Intern", "Junior", "Mid", "Senior", "Lead"]
CARD_LOCATIONS = ["Hà Nội", "Hồ Chí Minh", "Đà Nẵng", "Cần Thơ", "Remote",
                  "Ha Noi", "Ho Chi Minh", "Da Nang", "Can Tho",
                  "Hanoi", "HCMC", "HCM"]
CARD_HIDDEN_SALARY = "Login to view salary"
TITLE_JOB_WORDS = ["senior", "junior", "lead", "engineer", "developer", "manager",
                   "analyst", "scientist", "ai", "ml", "data", "nlp", "cv"]
WORK_MODES = [("Remote", ["remote"]), ("Hybrid", ["hybrid"]),
              ("On-site", ["at office", "onsite"])]
WORK_MODE_DEFAULT = "Full-time"
BENEFIT_CUT_MARKER = "cập nhật gần nhất"
BENEFIT_TAIL_MARKERS = ["xem thêm nộp hồ sơ", "xem thêm", "nộp hồ sơ online"]
EXPERIENCE_PHRASES = [
    r"(?:minimum\s+|at\s+least\s+|over\s+|more\s+than\s+)?\d+\s*[–\-]\s*?\d*\s*\+?\s*years?\s+(?:of\s+)?experience",
    r"\d+\s*\+?\s*years?\s+(?:of\s+)?experience",
    r"experience[:\s]+\d+\s*[–\-]\s*\d+\s*years?",
    r"experience[:\s]+\d+\s*\+?\s*years?",
    r"(?:ít\s+nhất|tối\s+thiểu|từ|trên|hơn)\s*\d+\s*[–\-]\s*?\d*\s*năm",
    r"\d+\s*[–\-]\s*\d+\s*năm\s*kinh\s*nghiệm",
    r"\d+\s*năm\s*kinh\s*nghiệm",
    r"\d+\s*năm\s*(?:làm\s*việc|thực\s*tế|chuyên\s*môn)?",
    r"\d+\s*[–\-]\s*\d+\s+years?",
]
# (pattern, days per unit); 0 = same day
RELATIVE_DATE_RULES = [
    (r"(?iu)(\d+)\s*(?:day|ngày|days)\s*ago", 1),
    (r"(?iu)(\d+)\s*(?:week|tuần|weeks)\s*ago", 7),
    (r"(?iu)(\d+)\s*(?:month|tháng|months)\s*ago", 30),
    (r"(?iu)(\d+)\s*(?:hour|giờ|hours)\s*ago", 0),
    (r"(?iu)(\d+)\s*(?:minute|phút|minutes)\s*ago", 0),
    (r"(?iu)(\d+)\s*ngày\s*trước", 1),
    (r"(?iu)(\d+)\s*tuần\s*trước", 7),
    (r"(?iu)(\d+)\s*tháng\s*trước", 30),
]
TODAY_WORDS = ["today", "hôm nay", "just now", "vừa đăng", "vừa xong"]
YESTERDAY_WORDS = ["yesterday", "hôm qua"]

VALID_JOB_TITLES = [
    "AI Engineer", "Machine Learning Engineer", "ML Engineer",
    "Data Scientist", "Data Analyst", "Data Engineer",
    "NLP Engineer", "Computer Vision Engineer", "CV Engineer",
    "MLOps Engineer", "LLM Engineer", "Generative AI Engineer",
    "GenAI Engineer", "Deep Learning Engineer",
    "Business Intelligence", "BI Developer", "Analytics Engineer",
    "Data Architect", "Big Data", "AI Developer", "AI Researcher",
    "Backend Developer", "Backend Engineer",
    "Software Engineer", "Software Developer",
    "Java Developer", "Python Developer", "Node.js Developer",
    "Go Developer", "C++ Developer", "Golang Developer",
    "PHP Developer", "Ruby Developer", ".NET Developer",
    "API Developer", "Microservices",
    "Frontend Developer", "Frontend Engineer",
    "React Developer", "Vue Developer", "Angular Developer",
    "iOS Developer", "Android Developer", "Mobile Developer",
    "React Native", "Flutter Developer",
    "Full-stack Developer", "Fullstack Developer",
    "Full Stack Engineer",
    "DevOps Engineer", "SRE", "Site Reliability",
    "Cloud Engineer", "AWS Engineer", "GCP Engineer",
    "Kubernetes", "Docker", "Platform Engineer",
    "Infrastructure Engineer",
    "Security Engineer", "Cybersecurity",
    "QA Engineer", "Test Engineer", "Automation Tester",
    "Blockchain Developer", "Embedded Engineer",
    "Solution Architect", "Technical Lead",
    "Product Manager", "Technical Project Manager",
    "Database Administrator", "DBA",
    "System Administrator", "Network Engineer",
    "Scrum Master", "Agile Coach",
    "Business Analyst", "System Analyst",
    "ERP", "SAP", "Salesforce",
]
VALID_JOB_KEYWORDS = [
    "machine learning", "deep learning", "artificial intelligence",
    "data science", "data analysis", "data engineering",
    "nlp", "natural language processing", "computer vision",
    "mlops", "llm", "generative ai", "transformer",
    "pytorch", "tensorflow", "scikit-learn",
    "software", "developer", "engineer", "programmer",
    "backend", "frontend", "fullstack", "full-stack",
    "devops", "cloud", "aws", "azure", "gcp",
    "mobile", "android", "ios", "react", "vue", "angular",
    "java", "python", "nodejs", "golang", "php", "swift",
    "database", "sql", "nosql", "mongodb", "postgresql",
    "qa", "testing", "automation", "selenium",
    "security", "cybersecurity", "penetration",
    "blockchain", "embedded", "iot",
    "solution architect", "technical lead",
    "product manager", "project manager",
]

# --- text analytics -------------------------------------------------------------
STOP_WORDS_VI = [
    "và", "hoặc", "của", "cho", "các", "với", "trong", "theo", "tại", "là",
    "có", "được", "một", "những", "này", "để", "khi", "về", "từ", "trên",
    "dưới", "ứng", "viên", "công", "việc", "kinh", "nghiệm", "yêu", "cầu",
    "mô", "tả", "phúc", "lợi", "quyền", "làm", "nhân", "sự",
]
STOP_WORDS_EN = [
    "and", "or", "the", "a", "an", "to", "for", "of", "in", "on", "with",
    "by", "from", "as", "is", "are", "be", "this", "that", "your", "you",
    "we", "our", "will", "can", "have", "has", "job", "work", "team",
]
KEEP_WORDS = [
    "python", "sql", "machine", "learning", "data", "engineer", "analyst",
    "scientist", "cloud", "aws", "azure", "gcp", "spark", "pytorch",
    "tensorflow", "tableau", "power", "bi", "docker", "kubernetes", "etl",
]

# --- résumé matching --------------------------------------------------------------
MATCH_WEIGHTS = {"skill_overlap": 0.60, "keyword_overlap": 0.20, "experience_alignment": 0.20}
SECTION_ALIASES = {
    "skills": ["skills", "technical skills", "kỹ năng", "ky nang", "core competencies",
               "technologies", "tools"],
    "experience": ["experience", "work experience", "employment", "kinh nghiệm", "kinh nghiem",
                   "professional experience"],
    "education": ["education", "học vấn", "hoc van", "academic background", "qualification"],
    "projects": ["projects", "project experience", "dự án", "du an", "portfolio"],
    "certifications": ["certifications", "certificates", "chứng chỉ", "chung chi"],
    "summary": ["summary", "profile", "objective", "career objective", "giới thiệu"],
}
YEARS_PATTERNS = [
    r"(\d+(?:\.\d+)?)\+?\s*(?:years?|yrs?)",
    r"(\d+(?:\.\d+)?)\+?\s*(?:năm|nam)\s*(?:kinh nghiệm|kinh nghiem)?",
]
LEARNING_SUGGESTIONS = {
    "Python": "Ôn Python cho data workflow: pandas, NumPy, notebook, clean code.",
    "SQL": "Luyện SQL joins, window functions, CTE, query optimization.",
    "Power BI": "Xây dashboard Power BI với data model, DAX cơ bản và storytelling.",
    "Tableau": "Luyện dashboard Tableau, calculated fields và visual analytics.",
    "Machine Learning": "Ôn supervised learning, feature engineering và model evaluation.",
    "Deep Learning": "Nắm neural networks, PyTorch/TensorFlow basics và transfer learning.",
    "PyTorch": "Thực hành tensor, training loop, dataset/dataloader và model fine-tuning.",
    "TensorFlow": "Thực hành Keras API, model training và deployment basics.",
    "Docker": "Đóng gói app bằng Dockerfile, image, container và compose.",
    "Kubernetes": "Nắm deployment, service, configmap và autoscaling ở mức cơ bản.",
    "AWS": "Ôn S3, EC2, IAM, Lambda và data services cơ bản.",
    "GCP": "Ôn BigQuery, Cloud Storage, IAM và Vertex AI basics.",
    "Azure": "Ôn Azure SQL, Blob Storage, Functions và ML basics.",
    "Apache Spark": "Luyện Spark DataFrame, PySpark transform và job optimization.",
    "Airflow": "Xây DAG ETL, schedule, retry và dependency management.",
}
LEARNING_TEMPLATE = ("Bổ sung ", " qua project nhỏ và thể hiện rõ trong phần kỹ năng/kinh nghiệm.")
WEEKDAY_LABELS = ["Thứ 2", "Thứ 3", "Thứ 4", "Thứ 5", "Thứ 6", "Thứ 7", "Chủ nhật"]
