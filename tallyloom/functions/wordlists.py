"""Word lists, labels and catalogs of the report rules, in their normalized spelling."""

# Words no person name holds.
NON_PERSON_WORDS = (
    "ADMINISTRACION", "ADMINISTRATIVAS", "ACLARATORIA", "ANALISIS", "AUDITORIA", "CARRERA", "CIENCIAS", "CLAVES",
    "COMERCIO", "CONTABILIDAD", "CORRECTAMENTE", "CRECIMIE", "CRECIMIENTO", "DEBE", "DESARROLLO", "DOCENTE",
    "EDUCACION", "ELECTRONICAMENTE", "ECUATORI", "ECUATORIANO", "ECUATORIANA", "EDOR", "EMPREND", "EMPRENDEDOR",
    "EMPRENDEDORA", "EMPRESAS", "ESTADO", "EXITO", "EXTERIOR", "EXPERIMENTALES", "FACULTAD", "FACULTADES",
    "FIRMADO", "IMPACTO", "GRUPO", "INGENIERIA", "INFORMACION", "INCOMPLETO", "INVESTIGACION", "INVESTIGADOR",
    "INVESTIGADORA", "INVESTIGADORES", "LICENCIATURA", "MUNDIAL", "MATEMATICAS", "NACION", "NOMBRE", "NOTA",
    "OBJETIVO", "PARA", "PARTICIPACION", "PARTICIPARON", "PEDAGOGIA", "PRESIONAR", "POSTULACION", "PRODUCTO",
    "PUBLICADO", "PROYECTO", "QUIMICA", "REGIONAL", "REVISION", "SEMILLERO", "SOBRE", "TITULO", "TRIBUTARIA",
    "UNIVERSIDAD", "ENVIAR", "INTERVINIENTES",
)
# Pieces that betray a wrapped non-name once the tokens are joined.
NON_PERSON_PIECES = (
    "ADMINISTRACION", "CRECIMIENTO", "ECUATORIANO", "ECUATORIANA", "EMPRENDEDOR", "EMPRENDEDORA", "FORMULARIO",
    "INVESTIGACION", "INTERVINIENTES", "LICENCIATURA", "POSTULACION", "SEMILLERO",
)
# Function words of a phrase.
FUNCTION_WORDS = ("DE", "DEL", "LA", "LAS", "LOS", "Y", "A", "AL", "COMO", "CON", "EL", "EN", "PARA", "POR", "UN", "UNA")
# Tokens that rule a member row out.
MEMBER_BLOCKED = (
    "ADMINISTRACION", "ADMINISTRATIVAS", "CARRERA", "CIENCIAS", "COMERCIO", "CONTABILIDAD", "FACULTAD", "FECHA",
    "FINANZAS", "FUNDACION", "GESTION", "INGENIERIA", "INGRES", "INFORMACION", "INSTITUTO", "LICENCIATURA",
    "MERCADOTECNIA", "QUIM", "QUIMICA", "UNIVERSIDAD", "UNIVERSITARIA",
)
# Months.
MONTHS = (
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
)
# Section headings by kind.
SECTION_ALIASES = {
    "integrantes_internos": (
        "Investigadores que participan en el grupo", "Investigadores que participan en el lupo",
        "Investigadores que participan en el proyecto", "Integrantes del grupo de investigacion", "Integrantes del grupo",
        "Integrantes del proyecto investigativo", "Integrantes del GI", "Equipo investigador", "Docentes investigadores",
        "Investigadores participantes", "Participantes internos",
    ),
    "integrantes_externos": (
        "Instituciones e investigadores externos", "Investigadores externos que participan del proyecto",
        "Investigadores externos", "Colaboradores externos", "Participantes externos", "Estudiantes participantes",
        "Estudiantes que participan", "Graduados participantes", "Egresados participantes", "Institucion externa investigador",
    ),
    "director_responsable": (
        "Director del proyecto", "Director del informe", "Responsable del informe", "Docente responsable",
        "Coordinador del grupo de investigacion", "Coordinador del proyecto", "Nombre del director", "Nombre del responsable",
    ),
    "proyectos_fci": (
        "Actividades realizadas por proyectos FCI vinculados a grupos de investigacion",
        "Codigo FCI proyecto director avance estado", "Proyectos FCI", "Proyectos vinculados",
    ),
    "produccion_cientifica": (
        "Produccion cientifica impacto mundial y regional", "Produccion cientifica", "Titulo autor estado impacto link",
    ),
    "intercambios": (
        "Intercambio de conocimiento participacion en grupos de investigacion", "Intercambio de conocimiento",
        "Participacion en grupos de investigacion",
    ),
    "actividades": ("Actividades realizadas por el proyecto y sus integrantes", "Actividades realizadas"),
    "fondos": ("Fondos externos obtenidos por el grupo de investigacion", "Fondos externos"),
    "grupo": ("Datos generales del proyecto de investigacion", "Datos generales", "Grupo de investigacion"),
}
# Markers that end a section.
NEGATIVE_MARKERS = ("INVESTIGADORES QUE SE DESVINCULAN", "INVESTIGADORES QUE INGRESAN", "FIRMAS", "EVIDENCIAS")
# Lines that are table headers, never section starts.
TABLE_HEADERS = (
    "INVESTIGADOR", "NOMBRE COMPLETO", "INSTITUCION EXTERNA", "FACULTAD", "CARRERA", "CODIGO FCI", "PROYECTO", "DIRECTOR",
    "ESTADO", "TITULO", "AUTOR", "AUTOR 1", "AUTOR 2", "AUTOR 3", "AUTOR 4", "AUTOR 5", "IMPACTO", "LINK",
    "FACULTAD INTERVINIENTE", "TIPO",
)
# Header lines skipped inside tables.
SKIPPED_HEADERS = (
    "ABOUT", "IMPACT", "O", "NOMBRE COMPLETO", "FACULTAD", "CARRERA", "FECHA DE INGRESO", "INSTITUCION EXTERNA",
    "INVESTIGADOR", "TITULO", "AUTOR 1", "AUTOR 2", "AUTOR 3", "AUTOR 4", "AUTOR 5", "ESTADO", "IMPACTO", "LINK",
    "+AGREGAR NUEVO REGISTRO",
)
# Header signatures of the table kinds.
TABLE_SIGNATURES = (
    ("integrantes_internos", ("NOMBRE COMPLETO", "FACULTAD", "CARRERA")),
    ("integrantes_internos", ("DOCENTE", "FACULTAD", "CARRERA")),
    ("integrantes_externos", ("INSTITUCION EXTERNA", "INVESTIGADOR")),
    ("integrantes_externos", ("NOMBRE COMPLETO", "INSTITUCION EXTERNA")),
    ("proyectos_fci", ("CODIGO FCI", "PROYECTO", "DIRECTOR", "AVANCE", "ESTADO")),
    ("produccion_cientifica", ("TITULO", "AUTOR", "ESTADO", "IMPACTO")),
    ("intercambios", ("FACULTAD INTERVINIENTE", "TIPO", "TITULO")),
)
# Signals of a progress report.
REPORT_SIGNALS = ("INFORME PARCIAL", "GRUPOS DE INVESTIGACION", "DATOS GENERALES", "CICLO ACADEMICO", "INVESTIGADORES", "PROYECTOS FCI")
# Signals of the report form.
FORM_SIGNALS = (
    "DATOS GENERALES DE GRUPOS DE INVESTIGACION", "DATOS GENERALES DEL PROYECTO DE INVESTIGACION", "DATOS GENERALES",
    "NOMBRE DEL GRUPO DE INVESTIGACION", "NOMBRE DEL GRUPO", "CICLO ACADEMICO QUE REPORTA", "CICLO ACADEMICO",
    "INVESTIGADORES QUE PARTICIPAN", "INVESTIGADORES QUE PARTICIPAN EN EL GRUPO",
    "INVESTIGADORES QUE PARTICIPAN EN EL PROYECTO", "INSTITUCIONES E INVESTIGADORES EXTERNOS", "INVESTIGADORES EXTERNOS",
    "SEGUIMIENTO A PROYECTOS FCI", "ACTIVIDADES REALIZADAS POR PROYECTOS FCI", "PROYECTOS FCI VINCULADOS",
)
# Signals of a captured mail.
MAIL_SIGNALS = (
    "OUTLOOK", "BANDEJA DE ENTRADA", "DESDE", "PARA", "CC", "ASUNTO", "ENVIADO", "1 ARCHIVO ADJUNTO",
    "OUTLOOK.CLOUD.MICROSOFT", "MAIL/ID", "MENSAJE ORIGINAL", "RE:", "RV:",
)
# Signals of letters and other paperwork.
PAPERWORK_SIGNALS = ("CARTA", "OFICIO", "SOLICITUD", "PRESENTACION", "MEMORANDO")
# Labels that end a labelled value.
STOP_LABELS = (
    "CORREO", "FECHA", "CICLO", "ANO", "UNIDAD", "CARRERA", "FACULTADES", "FACULTAD", "COORDINADOR", "DIRECTOR", "TUTOR",
    "INVESTIGADORES", "ESTUDIANTES", "RESUMEN", "SECCION",
)
# Labels of the general data of a report, with the most lines a value takes.
GENERAL_LABELS = {
    "code": (("CODIGO DE PROYECTO", "CODIGO DEL PROYECTO", "CODIGO DE SEMILLERO", "CODIGO DEL SEMILLERO", "CODIGO FCI"), 5),
    "title": (("TITULO DEL PROYECTO", "TITULO DEL SEMILLERO", "TITULO DE PROYECTO", "NOMBRE DEL GRUPO", "NOMBRE DEL GRUPO DE INVESTIGACION"), 8),
    "director": (("DIRECTOR DEL PROYECTO", "TUTOR DEL SEMILLERO", "COORDINADOR DEL GRUPO", "COORDINADOR DEL GRUPO DE INVESTIGACION", "RESPONSABLE DEL INFORME"), 4),
    "year": (("ANO DE CONVOCATORIA",), 2),
    "cycle": (("CICLO ACADEMICO QUE REPORTA", "CICLO ACADEMICO"), 2),
    "academic_unit": (("UNIDAD ACADEMICA PROPONENTE", "UNIDAD ACADEMICA"), 3),
    "career": (("CARRERA DEL DIRECTOR", "CARRERA DEL TUTOR", "CARRERA DEL COORDINADOR"), 4),
}
# Catalogs of the form.
CAREER_CATALOG = (
    "Licenciatura en Administracion de Empresas", "Licenciatura en Contabilidad y Auditoria",
    "Licenciatura en Comercio Exterior", "Licenciatura en Mercadotecnia", "Licenciatura en Finanzas",
    "Licenciatura en Gestion de la Informacion Gerencial", "Licenciatura en Turismo",
    "Licenciatura en Negocios Internacionales",
    "Licenciatura en Pedagogia de las Ciencias Experimentales de las Matematicas",
)
FACULTY_CATALOG = ("CIENCIAS ADMINISTRATIVAS", "FILOSOFIA Y LETRAS DE LA EDUCACION")
STATUS_CATALOG = ("Vigente", "Aprobado", "Publicado", "Enviado a revision", "Aceptado")
# Words that name the career, and the career they name.
CAREER_WORDS = (
    (("CONTABILIDAD", "AUDITORIA"), "Licenciatura en Contabilidad y Auditoria"),
    (("ADMINISTRACION", "EMPRESAS"), "Licenciatura en Administracion de Empresas"),
    (("COMERCIO", "EXTERIOR"), "Licenciatura en Comercio Exterior"),
    (("MERCADOTECNIA",), "Licenciatura en Mercadotecnia"),
    (("FINANZAS",), "Licenciatura en Finanzas"),
    (("GESTION", "INFORMACION"), "Licenciatura en Gestion de la Informacion Gerencial"),
    (("TURISMO",), "Licenciatura en Turismo"),
    (("NEGOCIOS", "INTERNACIONALES"), "Licenciatura en Negocios Internacionales"),
    (("PEDAGOGIA",), "Licenciatura en Pedagogia de las Ciencias Experimentales de las Matematicas"),
)
# Kinds of knowledge exchange.
INTERCHANGE_TYPES = ("CONFERENCIA", "PONENCIA", "CHARLA", "TALLER")
# Words of an institution name, the own institution, and spellings with accents.
INSTITUTION_WORDS = ("UNIVERSIDAD", "INSTITUTO", "ESCUELA", "CENTRO", "FUNDACION", "POLITECNICA")
OWN_INSTITUTION = ("UG", "UNIVERSIDAD DE GUAYAQUIL")
OWN_INSTITUTION_PIECE = "UNIVERSIDAD DE GUAYAQU"
INSTITUTION_SPELLINGS = {
    "UNIVERSIDAD DE ALMERIA": "Universidad de Almería", "UNIVERSIDAD DE MURCIA": "Universidad de Murcia",
    "UNIVERSIDAD ESTATAL DE MILAGRO": "Universidad Estatal de Milagro",
    "UNIVERSIDAD REGIONAL AMAZONICA": "Universidad Regional Amazónica",
}
# Text that follows a product title.
TITLE_TAILS = (
    " PUBLICAD", " PUBLICADO", " PUBLICADA", " ENVIADO", " EN REVISION", " ACEPTADO", " IMPACTO ", " REGIONAL", " MUNDIAL",
)
# Given names that betray authors glued to a title.
COMMON_NAMES = (
    "ANA", "ANIBAL", "CARLOS", "CARMEN", "DANIEL", "DENNISE", "DOLORES", "EMILIO", "FERNANDO", "GABRIEL", "HENRY", "JANINA",
    "JANNINA", "JORGE", "JOSE", "JOSUE", "MARIA", "PILAR", "RAFAEL", "ROBIN", "ROSA", "WENDY",
)
GLUED_NAMES = (
    "ANA", "CARLOS", "CARMEN", "DOLORES", "FERNANDO", "JANINA", "JOSE", "JOSUE", "MARIA", "PILAR", "ROSA", "VERA", "VITERI", "ZAMBRANO",
)
# Words that show a title inside identifier noise.
TITLE_TERMS = (
    "ANALISIS", "CADENA", "CONOCIMIENTO", "COOPERATIVAS", "CREDITO", "DECISIONES", "DESARROLLO", "ECUADOR", "EFICIENCIA",
    "EMPRESARIAL", "FINANCIERA", "GESTION", "GUAYAQUIL", "IMPORTANCIA", "INTELIGENTE", "MARCO", "MICROEMPRESAS", "PANDEMIA",
    "PLANIFICACION", "POTENCIAR", "RECURSOS", "TECNICA", "TECNOLOGIAS", "TEORIC", "TOMA", "TRIBUTARIA",
)
# Field text that is no title.
TITLE_NOISE = (
    "EVIDENCIA", "EVIDENCIAS", "ANEXO", "ADJUNTO", "OBSERVACION", "DESCRIPCION", "RESUMEN", "AVANCE",
    "AGREGAR NUEVO REGISTRO", "ACCIONES EJECUTADAS", "ACTIVIDADES REALIZADAS", "SE ADJUNTA", "CARTA DE ACEPTACION",
    "CARTA DE INVITACION", "LINK DE EVIDENCIA", "ENLACE DE EVIDENCIA", "PIRAMIDE CIENTIFICA", "EDITORIAL ENVIADO",
)
TITLE_FIELD_WORDS = ("REGIONAL", "REGIONAL .", "MUNDIAL", "IMPACTO", "ESTADO", "LINK", "PUBLICADO", "ACEPTADO")
TITLE_ROLE_WORDS = ("TUTOR", "ESTUDIANTE", "DOCTORANTE", "DOCENTE", "AUTOR")
TITLE_ROLE_ROWS = ("TUTOR DOCTORANTE", "TUTOR ESTUDIANTE", "TUTOR ESTUDIANTE 1 ESTUDIANTE 2")
IDENTIFIER_WORDS = ("HTTP", "WWW", " DOI ", "ISSN", "ISBN", "INDEX PHP", "DRIVE GOOGLE")
CUT_LAST_WORDS = ("A", "AL", "COMO", "CON", "DE", "DEL", "EL", "EN", "LA", "LAS", "LOS", "PARA", "POR", "Y")
CUT_PIECES = ("CORP", "CORPORAT", "ECONOMIC", "EMPR", "FINANCIE", "TEORIC", "SUMINISTR")
WRAPPED_SUFFIXES = ("l", "n", "o", "ad", "al", "ento", "nal", "nas", "os", "vas", "vo")
# Words of titles that no author holds, and given names that open a name.
PRODUCT_TITLE_WORDS = (
    "ANALISIS", "BANCARIO", "CADENA", "CAPITAL", "CONOCIMI", "CONOCIMIENTO", "COOPERATI", "CREDITO", "ECONOMIC", "ECONOMICO",
    "ECUADOR", "ECUATORIA", "EFICIENCIA", "EMPRESAS", "ESTRUCTURA", "FINANCIERO", "GESTION", "IMPACT", "IMPACTO", "INCIDENCIA",
    "INNOVACIO", "MODELO", "NUBE", "PANDEMIA", "PORTUARIAS", "PYMES", "RENTABILID", "SUMINISTR", "TECNICA", "TRABAJO", "TURISMO",
)
GIVEN_NAMES = (
    "ANIBAL", "CARLA", "CARLOS", "DANIEL", "DENNISE", "EMILIO", "FERNANDO", "HENRY", "JENIFFER", "JOSE", "JOSUE", "KAREN", "MARIA",
    "ROBIN", "WENDY", "YAIMARA",
)
NO_AUTHOR_WORDS = ("IMPACTO", "PUBLICADO", "ENVIADO", "REVISION", "REGIONAL", "MUNDIAL")
# Lines that state an impact.
IMPACT_LINES = ("IMPACTO", "MUNDIAL", "REGIONAL", "IMPACTO MUNDIAL", "IMPACTO REGIONAL")
# Labels of the report's vertical tables.
FIELD_LABELS = (
    "NOMBRE COMPLETO", "NOMBRE COMPLE TO", "FACULTAD", "CARRERA", "FECHA DE INGRESO", "INSTITUCION EXTERNA", "TITULO", "EDITORIAL",
    "AUTOR", "AUTOR 1", "AUTOR 2", "AUTOR 3", "AUTOR 4", "AUTOR 5", "ESTADO", "IMPACTO", "IMPACT", "LINK", "TO", "O",
)
# What is said about a title, by the rule that decides.
TITLE_REASONS = {
    "no_title": "Producto sin titulo legible.",
    "role_or_header": "Texto compatible con encabezado, rol academico o tabla; no se cuenta como producto cientifico.",
    "single_word": "Texto de una sola palabra; no alcanza para titulo de producto cientifico.",
    "unfinished_product": "Producto informado como no finalizado o incompleto; requiere revision.",
    "mixed_identifier": "Titulo mezclado con URL/identificador o metadatos OCR; requiere revision.",
    "identifier": "Texto compatible con URL, DOI o identificador, no con titulo de producto.",
    "field_noise": "Texto compatible con campos de tabla o evidencia; no se cuenta como producto cientifico.",
    "glued_authors": "Titulo con autores pegados; requiere revision antes de contar KPI.",
    "cut_title": "titulo truncado o incompleto",
    "short_title": "titulo truncado o incompleto",
    "valid": "Producto cientifico detectado desde seccion valida.",
}
