"""Schemas of the inputs (DDL text, as accepted by ``spark.read.schema`` and ``createDataFrame``)."""

RECEIPTS = (
    "id_recepcion long, fecha_hora timestamp, id_silo int, id_contrato long, peso_bruto_tn double, tara_tn double, "
    "humedad_pct double, impurezas_pct double, aceite_pct double, proteina_pct double, temperatura_grano_c double, "
    "calidad_grano string, numero_remision string"
)
CONTRACTS = (
    "id_contrato long, id_productor long, precio_acordado_usd_tn double, volumen_comprometido_tn double, "
    "precio_referencia_cbot double"
)
PLOTS = "id_productor long, superficie_ha double"
PRODUCERS = ("id_productor long, nombre_completo string, tipo_productor string, municipio string, "
             "area_total_ha double")
SILOS = "id_silo long, capacidad_tn double, temperatura_control boolean, stock_tn double"
SENSOR_READINGS = (
    "sensor_id string, timestamp_lectura timestamp, temperatura_c double, humedad_relativa_pct double, "
    "precipitacion_mm double, voltaje_bateria double, calidad_senal_dbm double"
)
TICKS = "ticker string, timestamp_mercado timestamp, precio_cotizacion double, volumen_tick double"
MONTHLY_PRICES = (
    "mes date, soya_grano double, soya_aceite double, soya_harina double, maiz double, petroleo double, urea double, "
    "dap double, potasio double, nino34_anomalia_c double"
)
MONTHLY_MATRIX = (
    "mes string, soya double, aceite double, pet double, nino double, n_rec long, vol double, hum double, "
    "imp double, merma double, vtas double, precio double, basis double"
)
SHIPMENTS = (
    "id_embarque long, id_venta long, id_puerto int, fecha_programada timestamp, fecha_real timestamp, "
    "cantidad_tn double, nave_barcaza string, estado_embarque string"
)
DISPATCHES = (
    "id_embarque long, id_transporte long, distancia_km double, costo_flete_usd double, fecha_salida timestamp, "
    "fecha_llegada timestamp, origen string, destino string"
)
