"""Rule tables of the products. All are defaults of parameters, none is used inside an operator."""
from __future__ import annotations

# Terms of government, ends inclusive, last one open.
GOVERNMENT_PERIODS = [
    {"id": "lula1", "label": "Lula 1", "start": "2003-01-01", "end": "2006-12-31"},
    {"id": "lula2", "label": "Lula 2", "start": "2007-01-01", "end": "2010-12-31"},
    {"id": "dilma1", "label": "Dilma 1", "start": "2011-01-01", "end": "2014-12-31"},
    {"id": "dilma2", "label": "Dilma 2", "start": "2015-01-01", "end": "2016-05-12"},
    {"id": "temer", "label": "Temer", "start": "2016-05-13", "end": "2018-12-31"},
    {"id": "bolsonaro", "label": "Bolsonaro", "start": "2019-01-01", "end": "2022-12-31"},
    {"id": "lula3", "label": "Lula 3", "start": "2023-01-01", "end": None},
]

# Terms for monthly spending, first days of months.
SPENDING_PERIODS = [
    {"id": "Dilma 1", "label": "Dilma 1", "start": "2013-01-01", "end": "2014-12-31"},
    {"id": "Dilma 2", "label": "Dilma 2", "start": "2015-01-01", "end": "2016-08-31"},
    {"id": "Temer", "label": "Temer", "start": "2016-09-01", "end": "2018-12-31"},
    {"id": "Bolsonaro", "label": "Bolsonaro", "start": "2019-01-01", "end": "2022-12-31"},
    {"id": "Lula 3", "label": "Lula 3", "start": "2023-01-01", "end": None},
]

# Spellings of a vote.
VOTE_VALUES = {
    "SIM": "Sim", "NÃO": "Não", "ABSTENÇÃO": "Abstenção", "OBSTRUÇÃO": "Obstrução",
    "ARTIGO 17": "Artigo 17", "ART. 17": "Artigo 17", "ART 17": "Artigo 17", "ART.17": "Artigo 17",
}

# Words of a procedural roll call (accent-free).
PROCEDURAL_WORDS = (
    "requerimento", "urgencia", "adiamento", "retirada de pauta", "inversao de pauta", "encerramento da discussao",
    "preferencia", "quebra de intersticio", "art. 155", "art 155", "destaque",
)

# Decisions on an information request.
DECISIONS = (
    "Acesso Concedido", "Acesso Negado", "Acesso Parcialmente Concedido", "Não se trata de solicitação de informação",
    "Informação Inexistente", "Órgão não tem competência para responder sobre o assunto", "Pergunta Duplicada/Repetida",
)
DENIED = "Acesso Negado"
RESTRICTED = ("Acesso Negado", "Acesso Parcialmente Concedido")
NO_DECISION = "Sem decisão registrada"
NO_REASON = "Motivo não informado"
FREE_TEXT = "Outros (texto livre)"
OTHER_REASONS = "Outros motivos"
OTHER_THEMES = "Outros temas"

# Words of a reason that protects personal data (accent-free).
PERSONAL_WORDS = (
    "dado pessoal", "dados pessoais", "informacao pessoal", "informacoes pessoais", "privacidade", "honra", "imagem",
    "lgpd", "sigilo bancario", "sigilo fiscal", "informacao de terceiro", "terceiro",
)

# Spellings of a reason.
REASONS = {
    "dados pessoais": "Dados pessoais",
    "dado pessoal": "Dados pessoais",
    "dados pessoais.": "Dados pessoais",
    "dados pessoais e sensíveis": "Dados pessoais e sensíveis",
    "pedido genérico": "Pedido genérico",
    "pedido incompreensível": "Pedido incompreensível",
    "pedido desproporcional ou desarrazoado": "Pedido desproporcional ou desarrazoado",
    "informação sigilosa de acordo com legislação específica": "Informação sigilosa de acordo com legislação específica",
    "parte da informação é sigilosa de acordo com legislação específica": "Parte da informação é sigilosa de acordo com legislação específica",
    "informacao classificada conforme artigos 23 e 24 da lei n 12.527/2011": "Informação classificada conforme artigos 23 e 24 da Lei nº 12.527/2011",
    "informação classificada conforme artigos 23 e 24 da lei nº 12.527/2011": "Informação classificada conforme artigos 23 e 24 da Lei nº 12.527/2011",
    "parte da informacao classificada conforme artigos 23 e 24 da lei n 12.527/2011": "Parte da informação classificada conforme artigos 23 e 24 da Lei nº 12.527/2011",
    "parte da informação classificada conforme artigos 23 e 24 da lei nº 12.527/2011": "Parte da informação classificada conforme artigos 23 e 24 da Lei nº 12.527/2011",
    "informação inexistente": "Informação inexistente",
    "parte da informação é inexistente": "Parte da informação é inexistente",
    "processo decisório em curso": "Processo decisório em curso",
    "parte da informação está relacionada a processo decisório em curso": "Parte da informação está relacionada a processo decisório em curso",
    "pedido exige tratamento adicional de dados": "Pedido exige tratamento adicional de dados",
    "parte da informação demandará mais tempo para produção": "Parte da informação demandará mais tempo para produção",
}

# Two-letter states.
STATES = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ",
    "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
)

# Labels of author and supporter roles.
ROLE_BENCH, ROLE_COMMITTEE, ROLE_RAPPORTEUR, ROLE_MEMBER = "Bancada", "Comissao", "Relatoria", "Parlamentar"
UNKNOWN_PARTY = "Nao identificado"

# Short names of spending units.
UNIT_LABELS = {
    "GABINETE DE SEGURANCA INSTITUCIONAL PR": "GSI",
    "AGENCIA BRASILEIRA DE INTELIGENCIA": "ABIN",
    "SECRETARIA DE ADMINISTRACAO PR": "Secretaria de Administração",
    "EMPRESA BRASIL DE COMUNICACAO S A": "EBC",
}


# Wording that reveals what an item is (accent-free).
EVENT_WORDS = (
    "palestra", "palestrante", "speaker", "workshop", "conference", "congresso", "seminar", "seminario",
    "webinar", "training", "udemy",
)
INTERVIEW_WORDS = ("entrevista", "interview", "podcast", "episode", "stage talks", "youtube", "spotify")
PROFILE_PATHS = ("/staff/",)
PROFILE_WORDS = ("speaker profile", "resume", "curriculo", "portfolio", "people", "orcid", "staff profile")
ECHO_LEADS = (
    "apos reportagem", "apos investigacao", "apos apuracao", "apos levantamento", "apos denuncia",
    "segundo reportagem", "segundo levantamento", "segundo apuracao", "segundo investigacao",
    "conforme reportagem", "conforme apuracao", "conforme levantamento", "como mostrou reportagem",
    "como revelou reportagem", "como revelou investigacao", "como revelou apuracao",
    "reportagem publicada pelo", "reportagem publicada pela",
)
# Fixed values: {} stands for the person's name.
ECHO_BY_NAME = ("reportagem de {}", "investigacao de {}", "apuracao de {}")
CITATION_BY_NAME = (
    "segundo {}", "de acordo com {}", "afirma {}", "explica {}", "disse {}", "diz {}", "aponta {}", "destaca {}",
    "avalia {}", "analisa {}", "comenta {}", "observa {}", "ressalta {}", "o jornalista {}", "o reporter {}",
    "o pesquisador {}", "o diretor {}", "o cofundador {}", "o professor {}", "jornalista {}", "according to {}",
    "says {}", "said {}", "told {}", "{}, who", "{}, diretor", "{}, cofundador", "{}, jornalista",
    "{}, pesquisador", "{}, reporter",
)
BYLINE_BY_NAME = (
    "por {}", "author {}", "author, {}", "reporter {}", "reportera {}", "reportagem: {}", "reportagem de {}",
    "texto: {}", "texto de {}", "apuracao: {}", "apuracao de {}",
)
# Hosts that need a higher score.
SOCIAL_HOSTS = ("linkedin.com", "facebook.com", "instagram.com")

# Paths of the crawl modes of a site.
ARTICLE_PATHS = ("/articles/",)
LISTING_PATHS = ("/colaborador/", "/page/")

# Themes of information requests with the words that tell them, tried in this order.
THEMES = (
    ("Dados pessoais e vida privada", (
        "dado pessoal", "dados pessoais", "informação pessoal", "informacao pessoal", "lgpd", "privacidade", "sigilo banc", "sigilo fiscal",
        "cpf", "cnpj", "prontuário", "prontuario", "endereço", "endereco")),
    ("Contratos, licitações e fornecedores", (
        "contrato", "licita", "pregão", "pregao", "edital", "fornecedor", "aditivo", "ata de registro", "dispensa de licita", "inexigibilidade")),
    ("Gastos públicos e orçamento", (
        "gasto", "despesa", "orçamento", "orcamento", "empenho", "pagamento", "nota fiscal", "diária", "diaria", "passagem", "custeio",
        "dotação", "dotacao")),
    ("Servidores, salários e concursos", (
        "servidor", "remuneração", "remuneracao", "salário", "salario", "cargo", "concurso", "nomeação", "nomeacao", "lotação", "lotacao",
        "folha de pagamento", "benefício de servidor")),
    ("Previdência e benefícios sociais", (
        "inss", "aposentadoria", "benefício", "beneficio", "pensão", "pensao", "auxílio", "auxilio", "bpc", "cadúnico", "cadunico",
        "bolsa família", "bolsa familia")),
    ("Saúde e medicamentos", ("medicamento", "hospital", "leito", "sus", "tratamento", "vacina", "saúde", "saude", "fila de espera")),
    ("Segurança pública e polícia", (
        "polícia", "policia", "delegacia", "boletim de ocorrência", "boletim de ocorrencia", "inquérito", "inquerito", "crime", "armamento",
        "prisão", "prisao", "pf")),
    ("Educação e pesquisa", ("escola", "universidade", "enem", "educação", "educacao", "matrícula", "matricula", "bolsa", "aluno", "professor")),
    ("Obras, infraestrutura e transportes", (
        "obra", "rodovia", "ponte", "aeroporto", "infraestrutura", "transporte", "pavimentação", "pavimentacao", "ferrovia")),
    ("Meio ambiente e território", (
        "desmatamento", "licença ambiental", "licenca ambiental", "ibama", "icmbio", "terra indígena", "terra indigena", "queimada",
        "mineração", "mineracao")),
    ("Processos administrativos e sanções", (
        "processo administrativo", "sindicância", "sindicancia", "pad", "multa", "auto de infração", "autos de infração", "sanção", "sancao")),
)

# Filters offered ready-made; an empty facet matches everything.
SEARCH_PRESETS = (
    {"id": "dados-pessoais", "label": "Negativas por dados pessoais", "filters": {"theme": "Dados pessoais e vida privada", "decision_group": "negado", "year": "", "org": ""}},
    {"id": "contratos", "label": "Contratos e licitações", "filters": {"theme": "Contratos, licitações e fornecedores", "decision_group": "negado", "year": "", "org": ""}},
    {"id": "servidores", "label": "Servidores e concursos", "filters": {"theme": "Servidores, salários e concursos", "decision_group": "negado", "year": "", "org": ""}},
    {"id": "inss-beneficios", "label": "INSS e benefícios", "filters": {"theme": "Previdência e benefícios sociais", "decision_group": "negado", "year": "", "org": ""}},
    {"id": "gastos-negados", "label": "Gastos públicos negados", "filters": {"theme": "Gastos públicos e orçamento", "decision_group": "negado", "year": "", "org": ""}},
)
